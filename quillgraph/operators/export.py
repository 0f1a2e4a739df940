"""Export of an allow-listed part of a corpus: new ids, rewritten links, checks that nothing else leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key


class Leak(Exception):
    """Something that is not allowed out would be published."""


def missing_entries(allowed: DataFrame, documents: DataFrame) -> DataFrame:
    """Allow-listed paths (path, public) that no document has."""
    return allowed.join(documents.select("path"), "path", "left_anti")


def export(documents: DataFrame, allowed: DataFrame, links: DataFrame, names: DataFrame) -> DataFrame:
    """(doc, path, markdown) of the allow-listed documents under their public ids.

    documents: doc, path, markdown; allowed: path, public; links: source, markup, target (null when
    unresolved), label; names: doc, name. A link to a public document points at its new id, any
    other becomes its label. Raises Leak if an entry is missing, or if a text still holds a name,
    of four characters or more, of a private document, in words.
    """
    lost = missing_entries(allowed, documents).limit(5).collect()
    if lost:
        raise Leak(f"not in the corpus: {', '.join(r['path'] for r in lost)}")
    chosen = documents.join(allowed, "path")
    ids = chosen.select(F.col("doc").alias("target"), F.col("public").alias("to"))
    new = links.join(ids, "target", "left").select("source", "markup", F.when(F.col("to").isNull(), F.col("label")).otherwise(F.concat(F.lit("["), F.lit("["), "to", F.lit("|"), "label", F.lit("]"), F.lit("]"))).alias("by"))
    changes = new.groupBy(F.col("source").alias("doc")).agg(F.collect_set(F.struct("markup", "by")).alias("changes"))
    # An element's transform shadows nothing: each change replaces one markup everywhere.
    text = F.aggregate(F.coalesce("changes", F.expr("CAST(array() AS array<struct<markup:string,by:string>>)")), F.col("markdown"), lambda t, c: F.replace(t, c["markup"], c["by"]))
    out = chosen.join(changes, "doc", "left").select(F.col("public").alias("doc"), F.concat("public", F.lit(".md")).alias("path"), text.alias("markdown"))
    private = names.join(chosen.select("doc"), "doc", "left_anti").select(name_key(F.col("name")).alias("k")).where(F.char_length("k") >= 4).distinct()
    found = leaked_names(out, private).limit(5).collect()
    if found:
        raise Leak(f"private names in public texts: {', '.join(r['k'] for r in found)}")
    return out


def leaked_names(texts: DataFrame, private: DataFrame) -> DataFrame:
    """(doc, k) of private names (k) in texts, as an equi-join on runs of as many words as the names have."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    keys = private.select("k", words("k").alias("w")).where(F.size("w") > 0).select("k", F.size("w").alias("n"), F.array_join("w", " ").alias("run"))
    sizes = [r["n"] for r in keys.select("n").distinct().orderBy("n").collect()]  # a few lengths
    held = texts.select("doc", words("markdown").alias("w"))
    if not sizes:
        return texts.select("doc", F.lit(None).cast("string").alias("k")).limit(0)

    def of(n: int):
        starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
        return F.when(F.size("w") >= n, F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))).otherwise(F.expr("CAST(array() AS array<string>)"))

    runs = held.select("doc", F.explode(F.flatten(F.array(*map(of, sizes)))).alias("run"))
    return runs.distinct().join(keys, "run").select("doc", "k").distinct()
