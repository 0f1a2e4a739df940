"""A published bundle: chosen notes under public names, with the evidence of semantic signals carried over, and read back.

Out: slugs from titles, links rewritten to them, and each locator moved to where the new text reads
the same. In: every range of evidence is checked against the bundle's own texts; of several signals
of a pair the strongest counts; pools, boundary and scores follow from the bundle alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.policy import BoundaryPolicy, Retrieval, ScorePolicy
from ..functions.text import fold_marks
from . import boundary, parse, relations, upkeep, vectors
from .export import Leak, leaked_names

#: Fixed patterns of what must not be published: local paths, keys, credentials; and embedded media.
PRIVATE = r"(?i)file://|(?:/Users/|/home/|[A-Z]:\\Users\\)|\bsk-[A-Za-z0-9_-]{16,}|-----BEGIN (?:RSA |OPENSSH )?PRIVATE KEY-----|(?:api[_-]?key|access[_-]?token|password)\s*[:=]\s*[\"']?[A-Za-z0-9_\-]{16,}"
MEDIA_TAGS = r"(?i)<(?:img|video|audio|source|iframe|object|embed)\b"

# -- out ------------------------------------------------------------------------------


def slugs(chosen: DataFrame) -> DataFrame:
    """doc, slug of chosen documents (doc, title): letters, digits and dashes, 80 at most, no two alike.

    Titles that give one slug get a part of their document's digest behind it; nothing is numbered,
    so no task sees all documents of a title.
    """
    base = F.substring(F.regexp_replace(F.regexp_replace(fold_marks(F.coalesce("title", F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 60)
    digest = F.sha2(F.col("doc").cast("binary"), 256)
    rows = chosen.select("doc", F.regexp_replace(F.when(base == "", "note").otherwise(base), "-+$", "").alias("slug"))
    twice = rows.groupBy("slug").agg(F.count("*").alias("_n")).where("_n > 1").select("slug", F.lit(True).alias("_twice"))
    rows = rows.join(twice, "slug", "left").select("doc", F.when(F.col("_twice"), F.concat("slug", F.lit("-"), F.substring(digest, 1, 12))).otherwise(F.col("slug")).alias("slug"))
    again = rows.groupBy("slug").agg(F.count("*").alias("_n")).where("_n > 1").select("slug", F.lit(True).alias("_again"))
    return rows.join(again, "slug", "left").select("doc", F.when(F.col("_again"), F.concat(F.substring("slug", 1, 15), F.lit("-"), digest)).otherwise(F.col("slug")).alias("slug"))


def link_changes(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc, changes: per document its links' places and what stands there in public, in order.

    links: doc, start, end, target_doc (null where unresolved), heading (null or text), label.
    Raises Leak where a link leads to no chosen document. chosen: doc, slug.
    """
    to = links.join(chosen.select("doc"), "doc", "left_semi").join(chosen.select(F.col("doc").alias("target_doc"), F.col("slug").alias("_to")), "target_doc", "left")
    lost = to.where("_to is null").limit(5).collect()
    if lost:
        raise Leak(f"links that lead to nothing public: {', '.join(r['doc'] for r in lost)}")
    by = F.concat(F.lit("["), F.lit("["), "_to", F.coalesce(F.concat(F.lit("#"), "heading"), F.lit("")), F.lit("|"), "label", F.lit("]"), F.lit("]"))
    return to.select("doc", F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), by.alias("by")).alias("c")).groupBy("doc").agg(F.sort_array(F.collect_list("c")).alias("changes"))


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start: bigint, end: bigint, by: string>>)")


def rewritten(notes: DataFrame, chosen: DataFrame, changes: DataFrame, private: DataFrame | None = None) -> DataFrame:
    """slug, path, markdown of the chosen notes (doc, markdown, content_start, media: number), without frontmatter, links changed.

    Raises Leak where a text holds media, a local path or something like a credential, or one of
    the private names (k).
    """
    rows = notes.join(chosen, "doc").join(changes, "doc", "left").withColumn("changes", F.coalesce("changes", _none()))
    start = F.struct(F.col("content_start").cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda a, c: F.struct(c["end"].alias("at"), F.concat(a["out"], F.substring(F.col("markdown"), (a["at"] + 1).cast("int"), (c["start"] - a["at"]).cast("int")), c["by"]).alias("out"))
    rest = lambda a: F.concat(a["out"], F.substring(F.col("markdown"), (a["at"] + 1).cast("int"), F.char_length("markdown")))
    out = rows.select("slug", F.concat("slug", F.lit(".md")).alias("path"), F.aggregate("changes", start, step, rest).alias("markdown"), "media")
    bad = out.where((F.col("media") > 0) | F.col("markdown").rlike(PRIVATE) | F.col("markdown").rlike(MEDIA_TAGS)).limit(5).collect()
    if bad:
        raise Leak(f"media, local paths or credentials in: {', '.join(r['slug'] for r in bad)}")
    if private is not None:
        found = leaked_names(out.select(F.col("slug").alias("doc"), "markdown"), private).limit(5).collect()
        if found:
            raise Leak(f"private names in public texts: {', '.join(r['k'] for r in found)}")
    return out.drop("media")


def remapped(locators: DataFrame, notes: DataFrame, chosen: DataFrame, changes: DataFrame, published: DataFrame) -> DataFrame:
    """locators (doc, start, end, ...) of chosen notes with doc, section, start and end as published; a locator that meets a changed link, or the frontmatter, goes.

    A place moves by what the links before it grew. Sections are those of the published text.
    """
    own = notes.select("doc", F.col("content_start").cast("long").alias("_from")).join(chosen, "doc").join(changes, "doc", "left").withColumn("changes", F.coalesce("changes", _none()))
    rows = locators.join(own, "doc")
    meets = F.exists("changes", lambda c: (c["start"] < F.col("end")) & (c["end"] > F.col("start")))
    moved = lambda p: F.col(p) - F.col("_from") + F.aggregate(F.filter("changes", lambda c: c["end"] <= F.col(p)), F.lit(0).cast("long"), lambda a, c: a + F.char_length(c["by"]) - (c["end"] - c["start"]))
    kept = rows.where(~meets & (F.col("start") >= F.col("_from")))
    extra = [c for c in locators.columns if c not in ("doc", "section", "start", "end")]
    placed = kept.select(F.col("slug").alias("doc"), moved("start").alias("start"), moved("end").alias("end"), *extra)
    parsed = parse.parse_notes(published.select(F.col("slug").alias("doc"), "path", "markdown"))
    sections = parse.child(parsed, "sections").select("doc", "section", F.col("start").alias("s"), F.col("end").alias("e"), "depth")
    return upkeep.deepest_sections(placed, sections)


# -- in -------------------------------------------------------------------------------


def evidence_faults(signals: DataFrame, documents: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """id, reason of the signals (id, evidence: array of doc, section, start, end) with a range that the texts (doc, markdown) do not have."""
    ranges = signals.select("id", F.explode_outer("evidence").alias("e")).select("id", "e.doc", "e.section", "e.start", "e.end")
    met = ranges.join(documents.select("doc", F.char_length("markdown").alias("_n")), "doc", "left")
    reason = F.when(F.col("doc").isNull(), "no evidence").when(F.col("_n").isNull(), "unknown document").when(~((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("_n"))), "range")
    if sections is not None:
        met = met.join(sections.select("doc", "section", F.col("start").alias("_s"), F.col("end").alias("_e")), ["doc", "section"], "left")
        reason = reason.when(F.col("_s").isNull(), "unknown section").when((F.col("start") < F.col("_s")) | (F.col("end") > F.col("_e")), "outside its section")
    return met.select("id", reason.alias("reason")).where("reason is not null").groupBy("id").agg(F.min("reason").alias("reason"))


def load(documents: DataFrame, signals: DataFrame, space: str) -> DataFrame:
    """The signals (id, doc_a, doc_b, similarity, space, evidence) of a bundle, checked.

    ValueError if a signal is of another space, or its evidence does not fit the texts (doc, path,
    markdown): a bundle is taken whole or not at all.
    """
    parsed = parse.parse_notes(documents)
    sections = parse.child(parsed, "sections")
    other = signals.where(~F.col("space").eqNullSafe(F.lit(space))).select("id", F.lit("space").alias("reason"))
    bad = other.unionByName(evidence_faults(signals, documents, sections)).limit(5).collect()
    if bad:
        raise ValueError("signals that do not fit: " + ", ".join(f"{r['id']} ({r['reason']})" for r in bad))
    return signals


def still_valid(signals: DataFrame, published: DataFrame, now: DataFrame) -> DataFrame:
    """The signals whose two documents, and those of their evidence, have the texts that were published; both: doc, markdown."""
    hashes = lambda d, c: d.select("doc", F.sha2(F.col("markdown").cast("binary"), 256).alias(c))
    same = hashes(published, "_a").join(hashes(now, "_b"), "doc").where("_a = _b").select("doc")
    touched = F.array_distinct(F.concat(F.array("doc_a", "doc_b"), F.transform(F.coalesce("evidence", F.array()), lambda e: e["doc"])))
    gone = signals.select("id", F.explode(touched).alias("doc")).join(same, "doc", "left_anti").select("id").distinct()
    return signals.join(gone, "id", "left_anti").select(*signals.columns)


def pools(signals: DataFrame, retrieval: Retrieval = Retrieval()) -> DataFrame:
    """(center, neighbor, similarity, rank, pool_size) from signals (doc_a, doc_b, similarity): a pair once, with its strongest."""
    a, b = F.least("doc_a", "doc_b"), F.greatest("doc_a", "doc_b")
    pairs = signals.where("doc_a <> doc_b").groupBy(a.alias("node_a"), b.alias("node_b")).agg(F.max("similarity").alias("similarity"))
    ends = relations.by_center(pairs)
    of = W.partitionBy("center")
    rows = ends.select("center", "neighbor", "similarity", F.row_number().over(of.orderBy(F.desc("similarity"), "neighbor")).alias("rank"), F.count("*").over(of).alias("pool_size"))
    return rows.where(F.col("rank") <= retrieval.budget)


def neighborhoods(pool: DataFrame, deterministic: DataFrame, retrieval: Retrieval = Retrieval(), limits: BoundaryPolicy = BoundaryPolicy(), policy: ScorePolicy = ScorePolicy()) -> DataFrame:
    """Each document's scored relations (center, neighbor, ..., score): mentions and links (by_center of candidates) with the accepted part of its pool."""
    accepted = boundary.decisions(pool, limits).where("accepted").withColumn("strength", vectors.strength(F.col("similarity"), "text-text", retrieval))
    return relations.score(relations.merge_semantic(deterministic, accepted), policy)


def cross(centered: DataFrame, focuses: DataFrame) -> DataFrame:
    """(focus, node_a, node_b, score): relations among a focus's neighbors that both their ends have, with the score of the end that the focus lists later.

    centered: center, neighbor, node_a, node_b, score. A relation meets the focuses of the end that has fewer.
    """
    order = F.row_number().over(W.partitionBy("center").orderBy(F.desc("score"), "neighbor"))
    listed = centered.select(F.col("center").alias("focus"), F.col("neighbor").alias("_n"), order.alias("_at")).join(focuses.select(F.col("doc").alias("focus")), "focus", "left_semi")
    of = lambda c: F.max(F.when(F.col("center") == F.col(c), F.col("score")))
    both = centered.groupBy("node_a", "node_b").agg(of("node_a").alias("_sa"), of("node_b").alias("_sb")).where("_sa is not null and _sb is not null")
    degree = listed.groupBy("_n").agg(F.count("*").alias("_d"))
    sized = both.join(degree.toDF("node_a", "_da"), "node_a").join(degree.toDF("node_b", "_db"), "node_b")
    low = F.col("_da") <= F.col("_db")
    side = lambda c, a, b: F.when(low, F.col(a)).otherwise(F.col(b)).alias(c)
    turned = sized.select("node_a", "node_b", side("_few", "node_a", "node_b"), side("_many", "node_b", "node_a"), side("_sf", "_sa", "_sb"), side("_sm", "_sb", "_sa"))
    met = turned.join(listed.select("focus", F.col("_n").alias("_few"), F.col("_at").alias("_af")), "_few").join(listed.select("focus", F.col("_n").alias("_many"), F.col("_at").alias("_am")), ["focus", "_many"])
    return met.select("focus", "node_a", "node_b", F.when(F.col("_af") > F.col("_am"), F.col("_sf")).otherwise(F.col("_sm")).alias("score"))
