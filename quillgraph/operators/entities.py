"""Names and what they mean: the dictionary, name resolution, link resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import admissible, name_key, normal_path, path_key


def dictionary(names: DataFrame, aliases: DataFrame | None = None, sections: DataFrame | None = None) -> DataFrame:
    """(name_key, doc, section, source, allow_short) of all names.

    names: doc, name, source. aliases: name, doc, section, allow_short; only those whose document,
    and section if they name one, exist are taken (left semi joins).
    """
    own = names.select(name_key(F.col("name")).alias("name_key"), "doc", F.lit(None).cast("string").alias("section"), "source", F.lit(False).alias("allow_short"))
    if aliases is None:
        return own
    known = aliases.join(names.select("doc").distinct(), "doc", "left_semi")
    if sections is not None:
        known = known.where("section is null").unionByName(known.where("section is not null").join(sections.select("doc", "section"), ["doc", "section"], "left_semi"))
    return own.unionByName(known.select(name_key(F.col("name")).alias("name_key"), "doc", "section", F.lit("user").alias("source"), "allow_short"))


def resolutions(entities: DataFrame) -> DataFrame:
    """One row per key: status, candidates (different documents and sections), target of a resolved one.

    A key none of whose definitions is admissible is suppressed; once one is, all count.
    """
    # Two levels of partial aggregation: no row ever holds all documents of a frequent name.
    place = ["name_key", "doc", F.coalesce("section", F.lit("")).alias("section")]
    each = entities.groupBy(*place).agg(F.max(admissible(F.col("name_key"), F.col("allow_short"))).alias("ok"))
    made = each.groupBy("name_key").agg(F.count("*").alias("candidates"), F.max("ok").alias("ok"), F.min("doc").alias("first"))
    status = F.when(~F.col("ok"), "suppressed").when(F.col("candidates") == 1, "resolved").otherwise("ambiguous")
    return made.select("name_key", status.alias("status"), "candidates", F.when(status == "resolved", F.col("first")).alias("target"))


def resolve_names(rows: DataFrame, entities: DataFrame, column: str) -> DataFrame:
    """rows with status, candidates and target of the name in ``column``; unknown names are missing."""
    found = resolutions(entities)
    joined = rows.withColumn("name_key", name_key(F.col(column))).join(found, "name_key", "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("missing"))).withColumn("candidates", F.coalesce("candidates", F.lit(0)))


def resolve_links(links: DataFrame, entities: DataFrame, documents: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """links (source, raw) with status, candidates, target and target_section.

    ``#heading`` is split off. An empty document part is the source itself; one with a slash, a
    backslash or ``.md`` is a path (a leading dot joins the source's folder), case-sensitive and
    never looked up as a name; anything else is a name. A heading is looked up in a resolved
    document: documents: doc, path; sections: doc, section, title, depth.
    """
    cut = F.instr("raw", "#")
    rows = links.withColumn("_part", F.trim(F.when(cut > 0, F.substring(F.col("raw"), F.lit(1), cut - 1)).otherwise(F.col("raw")))).withColumn("_heading", F.when(cut > 0, F.substring(F.col("raw"), cut + 1, F.length("raw"))))
    is_path = F.col("_part").rlike(r"[/\\]") | F.col("_part").rlike(r"(?i)\.md$")
    rows = rows.withColumn("_kind", F.when(F.col("_part") == "", "self").when(is_path, "path").otherwise("name"))
    paths = documents.select(path_key(F.col("path")).alias("_key"), F.col("doc").alias("_path_doc"))
    places = documents.select(F.col("doc").alias("source"), F.regexp_replace("path", "[^/]*$", "").alias("_folder"))
    found = resolutions(entities).select(F.col("name_key").alias("_key"), F.col("status").alias("_s"), F.col("candidates").alias("_n"), F.col("target").alias("_t")).where("_s <> 'suppressed'")
    own = rows.where("_kind = 'self'").withColumn("_hits", F.lit(1)).withColumn("target", F.col("source"))
    full = F.when(F.col("_part").startswith("."), F.concat(F.coalesce("_folder", F.lit("")), F.col("_part"))).otherwise(F.col("_part"))
    by_path = rows.where("_kind = 'path'").join(places, "source", "left").withColumn("_key", path_key(normal_path(full))).join(paths, "_key", "left")
    by_path = by_path.withColumn("_hits", F.col("_path_doc").isNotNull().cast("int")).withColumn("target", F.col("_path_doc"))
    by_name = rows.where("_kind = 'name'").withColumn("_key", name_key(F.col("_part"))).join(found, "_key", "left").withColumn("_hits", F.coalesce("_n", F.lit(0)).cast("int")).withColumn("target", F.col("_t"))
    keep = [*links.columns, "_heading", "_hits", "target"]
    all_ = own.select(*keep).unionByName(by_path.select(*keep)).unionByName(by_name.select(*keep))
    if sections is None:
        status = F.when(F.col("_hits") == 0, "missing").when(F.col("_hits") == 1, "resolved").otherwise("ambiguous")
        return all_.select(*links.columns, status.alias("status"), F.col("_hits").cast("long").alias("candidates"), F.when(status == "resolved", F.col("target")).alias("target"), F.lit(None).cast("string").alias("target_section"))
    heads = sections.where("depth > 0").groupBy(F.col("doc").alias("target"), name_key(F.col("title")).alias("_h")).agg(F.count("*").alias("_heads"), F.min("section").alias("_section"))
    all_ = all_.withColumn("_h", name_key(F.col("_heading"))).join(heads, ["target", "_h"], "left")
    named = F.coalesce(F.trim("_heading"), F.lit("")) != ""
    count = F.when(named & (F.col("_hits") == 1), F.coalesce("_heads", F.lit(0))).otherwise(F.col("_hits"))
    status = F.when(count == 0, "missing").when(count == 1, "resolved").otherwise("ambiguous")
    return all_.select(*links.columns, status.alias("status"), count.cast("long").alias("candidates"), F.when(status == "resolved", F.col("target")).alias("target"), F.when(named & (status == "resolved"), F.col("_section")).alias("target_section"))
