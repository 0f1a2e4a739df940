"""Relations: evidence grouped by unordered pair, scored, and the global graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keep import kept
from ..functions.policy import ScorePolicy
from ..functions.text import round12


def pairs(evidence: DataFrame) -> DataFrame:
    """evidence (kind, source, target, status, section) with node_a < node_b; only resolved, never a node with itself."""
    kept = evidence.where("status = 'resolved' and source <> target")
    return kept.withColumn("node_a", F.least("source", "target")).withColumn("node_b", F.greatest("source", "target"))


def candidates(evidence: DataFrame) -> DataFrame:
    """(node_a, node_b, sections, mentions, links): per pair the different (document, section) of mentions in both directions, and counts."""
    mention = F.col("kind") == "mention"
    return pairs(evidence).groupBy("node_a", "node_b").agg(
        F.countDistinct(F.when(mention, F.struct("source", "section"))).alias("sections"), F.count_if(mention).alias("mentions"), F.count_if(F.col("kind") == "explicit").alias("links")
    )


def mention_part(sections: Column, policy: ScorePolicy) -> Column:
    grown = F.lit(policy.mention_base) + (sections - 1) * F.lit(policy.section_increment)
    return F.when(sections > 0, F.least(F.lit(policy.mention_cap), grown)).otherwise(F.lit(0.0))


def combine(mention: Column, explicit: Column, semantic: Column, policy: ScorePolicy) -> Column:
    """The stronger of mention and semantic, raised by a link by a share of what is missing to 1."""
    best = F.greatest(mention, semantic)
    return round12(best + F.lit(policy.explicit_boost) * explicit * (1 - best))


def score(pairs_: DataFrame, policy: ScorePolicy = ScorePolicy()) -> DataFrame:
    """candidates with mention, explicit, semantic and score; a column ``strength`` holds the strongest semantic signal, if any."""
    strength = F.coalesce(F.col("strength"), F.lit(0.0)) if "strength" in pairs_.columns else F.lit(0.0)
    rows = pairs_.withColumn("mention", mention_part(F.col("sections"), policy)).withColumn("explicit", (F.col("links") > 0).cast("int")).withColumn("semantic", strength)
    return rows.withColumn("score", combine(F.col("mention"), F.col("explicit"), F.col("semantic"), policy))


def with_overrides(relations: DataFrame, overrides: DataFrame) -> DataFrame:
    """relations with hidden and pinned of their overrides (node_a, node_b, hidden, pinned); hidden wins over pinned."""
    joined = relations.join(overrides, ["node_a", "node_b"], "left").withColumn("hidden", F.coalesce("hidden", F.lit(False)))
    return joined.withColumn("pinned", F.coalesce("pinned", F.lit(False)) & ~F.col("hidden"))


def by_center(relations: DataFrame) -> DataFrame:
    """Each relation from both of its ends: center, neighbor, and its columns."""
    ends = F.explode(F.array(F.struct(F.col("node_a").alias("center"), F.col("node_b").alias("neighbor")), F.struct(F.col("node_b").alias("center"), F.col("node_a").alias("neighbor"))))
    return relations.withColumn("_end", ends).select(F.col("_end.center").alias("center"), F.col("_end.neighbor").alias("neighbor"), *relations.columns)


def merge_semantic(deterministic: DataFrame, accepted: DataFrame) -> DataFrame:
    """Per center the deterministic relations with accepted semantic ones, a pair in both once.

    deterministic: by_center of candidates; accepted: center, neighbor, strength.
    """
    right = accepted.select("center", "neighbor", "strength")
    joined = deterministic.select("center", "neighbor", "sections", "mentions", "links").join(right, ["center", "neighbor"], "full_outer")
    filled = joined.fillna(0, ["sections", "mentions", "links"])
    return filled.withColumn("node_a", F.least("center", "neighbor")).withColumn("node_b", F.greatest("center", "neighbor"))


def global_edges(centered: DataFrame) -> DataFrame:
    """The union over all centers, a pair once with its best score, without hidden ones."""
    shown = centered.where(~F.col("hidden")) if "hidden" in centered.columns else centered
    return shown.groupBy("node_a", "node_b").agg(F.max("score").alias("score"))


def global_nodes(documents: DataFrame, edges: DataFrame) -> DataFrame:
    """Every document with its degree; isolated ones have 0."""
    degree = by_center(edges).groupBy(F.col("center").alias("doc")).agg(F.count("*").alias("degree"))
    return documents.join(degree, "doc", "left").fillna(0, ["degree"])


#: Ranges that a global rank is counted in at most, and sampled rows for each.
RANGES, SAMPLED = 128, 16


def _range_of(rows: DataFrame) -> Column:
    """The range of a row in the order of falling degree, then of doc, between a few sampled rows: those with the least hashes."""
    some = rows.select("degree", "doc").orderBy(F.xxhash64("doc"), "doc").limit(RANGES * SAMPLED).collect()
    cuts = sorted({(-r["degree"], r["doc"]) for r in some})[SAMPLED - 1 :: SAMPLED]
    if not cuts:
        return F.lit(0)
    place = lambda d, x: F.struct(d.cast("long").alias("a"), x.alias("b"))
    own = place(-F.col("degree"), F.col("doc"))
    return F.size(F.filter(F.array(*(place(F.lit(d), F.lit(x)) for d, x in cuts)), lambda c: c < own))


def label_rank(nodes: DataFrame, fraction: float = 0.3, least: int = 3) -> DataFrame:
    """Nodes whose label a zoom tier shows: the first part of them by degree, ties by id, and ``least`` at least.

    The order is cut into ranges at sampled rows, so equal degrees are spread too; a range's rows
    are ranked in one task, after the rows of the ranges before it are counted.
    """
    nodes = kept(nodes)  # sampled, counted and ranked
    ranged = nodes.withColumn("_range", _range_of(nodes))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a range
    shown = F.greatest(F.lit(least), F.ceil(F.round(F.sum("_n").over(W.partitionBy()) * fraction, 9)))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"), shown.alias("_shown")).where("_before < _shown")
    own = F.row_number().over(W.partitionBy("_range").orderBy(F.desc("degree"), "doc"))
    ranked = ranged.join(F.broadcast(before), "_range").withColumn("label_rank", (F.col("_before") + own).cast("long"))
    return ranked.where(F.col("label_rank") <= F.col("_shown")).drop("_range", "_before", "_shown")


def merge_overrides(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Overrides (node_a, node_b, hidden, pinned, note) after changes, where null keeps what was; ends are put in order, empty ones go."""
    ordered = changes.withColumn("_a", F.least("node_a", "node_b")).withColumn("_b", F.greatest("node_a", "node_b"))
    new = ordered.select(F.col("_a").alias("node_a"), F.col("_b").alias("node_b"), *(F.col(c).alias(f"_{c}") for c in ("hidden", "pinned", "note"))).where("node_a <> node_b")
    joined = current.join(new, ["node_a", "node_b"], "full_outer")
    rows = joined.select("node_a", "node_b", *(F.coalesce(f"_{c}", c).alias(c) for c in ("hidden", "pinned", "note")))
    return rows.where(F.coalesce("hidden", F.lit(False)) | F.coalesce("pinned", F.lit(False)) | (F.coalesce(F.trim("note"), F.lit("")) != ""))
