"""Small composed queries that the serving surfaces ask: pages, packed evidence, reveals, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .explore import visible


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page of rows in a total order; limits are 1 to 500."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be from 1 to 500, offset 0 at least")
    return rows.orderBy(*order).offset(offset).limit(limit)


def references(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """Mentions and links as one list: source, start, kind, target."""
    m = mentions.select("source", "start", F.lit("mention").alias("kind"), "target")
    return m.unionByName(links.select("source", "start", F.lit("wiki").alias("kind"), "target"))


def pack_evidence(evidence: DataFrame, center_chars: DataFrame, total: int = 20_000, center_most: int = 6_000, most: int = 2_000) -> DataFrame:
    """evidence (center, rank, chars) with taken: how much of each fits the budget that the center's own text leaves.

    What a piece may take is bounded by itself, so what is left for it is a running sum in one sort by center and rank.
    """
    left = (F.lit(total) - F.least(F.coalesce("_own", F.lit(0)), F.lit(center_most))).cast("int")
    rows = evidence.select("center", F.col("rank").cast("int").alias("rank"), F.least("chars", F.lit(most)).cast("int").alias("_most"))
    rows = rows.join(center_chars.select("center", F.col("chars").alias("_own")), "center", "left")
    before = F.coalesce(F.sum("_most").over(W.partitionBy("center").orderBy("rank", "_most").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.select("center", "rank", F.greatest(F.lit(0), F.least(F.col("_most"), left - before)).cast("int").alias("taken"))


def newly_visible(centered: DataFrame, before: int, after: int, budget: int | None = None) -> DataFrame:
    """What a lens move shows that was not shown."""
    now = visible(centered, after, budget).select("center", "neighbor", "score")
    return now.join(visible(centered, before, budget).select("center", "neighbor"), ["center", "neighbor"], "left_anti")


def beyond(centered: DataFrame, lens: int, budget: int, most: int) -> DataFrame:
    """The first relations of each center that are neither hidden nor visible."""
    rest = centered.where(~F.col("hidden")).join(visible(centered, lens, budget).select("center", "neighbor"), ["center", "neighbor"], "left_anti")
    return rest.withColumn("rank", F.row_number().over(W.partitionBy("center").orderBy(F.desc("score"), "neighbor"))).where(F.col("rank") <= most)


def signal_kinds(evidence_pairs: DataFrame) -> DataFrame:
    """(node_a, node_b, kinds): the different kinds of signals of each pair, in order."""
    return evidence_pairs.groupBy("node_a", "node_b").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def path_tree(paths: DataFrame) -> DataFrame:
    """(path, parent, depth, folder, place, siblings) of all paths and their folders; folders stand first among siblings."""
    parts = F.split("path", "/")
    each = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("parent"), i.alias("depth"), (i < F.size(parts)).alias("folder")))).alias("n"))
    nodes = each.select("n.*").groupBy("path", "parent", "depth").agg(F.max("folder").alias("folder"))
    w = W.partitionBy("parent")
    return nodes.withColumn("place", F.row_number().over(w.orderBy(F.desc("folder"), "path"))).withColumn("siblings", F.count("*").over(w))


#: Digits that a number is filled up to, so that equal lengths compare as numbers do; longer ones compare as text.
DIGITS = 40
#: Ranges that siblings are counted in at most, and sampled rows for each.
RANGES, SAMPLED = 64, 16


def natural_key(name: Column, locale: str = "zh") -> Column:
    """A key that orders names as a file tree shows them: by the locale's collation, with runs of digits as numbers."""
    number = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    parts = F.transform(F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0)), lambda x: F.when(x.rlike("^[0-9]"), F.when(F.char_length(number(x)) <= DIGITS, F.lpad(number(x), DIGITS, "0")).otherwise(number(x))).otherwise(x))
    return F.collate(F.array_join(parts, ""), locale)


def tree_order(tree: DataFrame, locale: str = "zh") -> DataFrame:
    """path_tree's rows with place and siblings in the order of a file tree: folders first, then by natural_key of the name, ties by path.

    The order of all siblings is cut into ranges at sampled rows; the rows of a folder within a
    range are numbered in one task, after its rows in the ranges before are counted, so a folder
    of any size is spread.
    """
    rows = tree.drop("place", "siblings").withColumn("_k", natural_key(F.substring_index("path", "/", -1), locale))
    order = [F.col("parent"), F.desc("folder"), F.col("_k"), F.col("path")]
    some = rows.select("parent", "folder", "_k", "path", F.xxhash64("path").alias("_h")).orderBy("_h", "path").limit(RANGES * SAMPLED)
    cuts = some.orderBy(*order).select("parent", "folder", F.col("_k").cast("string").alias("k"), "path").collect()[SAMPLED - 1 :: SAMPLED]

    place = lambda parent, folder, key, path: F.struct(parent.alias("a"), (~folder).alias("b"), key.alias("c"), path.alias("d"))
    limits = [place(F.lit(c["parent"]), F.lit(c["folder"]), F.collate(F.lit(c["k"]), locale), F.lit(c["path"])) for c in cuts]
    own = place(F.col("parent"), F.col("folder"), F.col("_k"), F.col("path"))
    ranged = rows.withColumn("_range", F.size(F.filter(F.array(*limits), lambda c: c < own)) if limits else F.lit(0))
    counted = ranged.groupBy("parent", "_range").agg(F.count("*").alias("_n"))  # a row for each folder and range
    of = W.partitionBy("parent")
    before = counted.select("parent", "_range", (F.sum("_n").over(of.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(of).alias("siblings"))
    own = F.row_number().over(W.partitionBy("parent", "_range").orderBy(*order[1:]))
    return ranged.join(before, ["parent", "_range"]).select(*tree.drop("place", "siblings").columns, (F.col("_before") + own).cast("long").alias("place"), "siblings")


def symmetric(centered: DataFrame) -> DataFrame:
    """Acceptance check: relations whose two ends disagree; empty for deterministic evidence."""
    return centered.groupBy("node_a", "node_b").agg(F.count("*").alias("ends"), F.min("score").alias("low"), F.max("score").alias("high")).where("ends <> 2 or low <> high")
