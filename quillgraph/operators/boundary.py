"""The statistical cut of a semantic pool: a significant gap, then a quality floor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.policy import EPSILON, MAD_SCALE, BoundaryPolicy


def gaps(pool: DataFrame) -> DataFrame:
    """pool (center, neighbor, similarity, rank) with the gap to the next rank, null at the last."""
    order = W.partitionBy("center").orderBy("rank")
    after = F.lead("similarity").over(order)
    return pool.withColumn("gap", F.when(after.isNotNull(), F.greatest(F.lit(0.0), F.col("similarity") - after)))


def diagnostics(pool: DataFrame, policy: BoundaryPolicy = BoundaryPolicy()) -> DataFrame:
    """One row per center: members, median_gap, mad, threshold, cut_rank (null: no significant gap)."""
    columns = ("members", "median_gap", "mad", "threshold", "cut_rank")
    return _measured(pool, policy).where("rank = _first").select("center", *columns)


def _measured(pool: DataFrame, policy: BoundaryPolicy) -> DataFrame:
    """pool with the diagnostics of its center on each row, by windows over one partitioning, so the pool is computed once."""
    one = W.partitionBy("center")
    g = gaps(pool).withColumn("members", F.count("*").over(one)).withColumn("median_gap", F.coalesce(F.median("gap").over(one), F.lit(0.0))).withColumn("_first", F.min("rank").over(one))
    g = g.withColumn("mad", F.coalesce(F.median(F.abs(F.col("gap") - F.col("median_gap"))).over(one), F.lit(0.0)))
    g = g.withColumn("threshold", F.col("median_gap") + F.greatest(F.lit(policy.minimum_gap), F.lit(policy.mad_multiplier * MAD_SCALE) * F.col("mad")))
    wide = (F.col("rank") >= policy.minimum_rank) & (F.col("gap") > F.col("threshold") + EPSILON) & (F.col("members") >= policy.minimum_candidates)
    return g.withColumn("cut_rank", F.min(F.when(wide, F.col("rank"))).over(one))


Strategy = Callable[[DataFrame, BoundaryPolicy], DataFrame]


def adaptive_gap(pool: DataFrame, policy: BoundaryPolicy) -> DataFrame:
    """pool with selected: the ranks before the first significant gap, or all."""
    return _measured(pool, policy).select(*pool.columns, (F.col("cut_rank").isNull() | (F.col("rank") <= F.col("cut_rank"))).alias("selected"))


def decisions(pool: DataFrame, policy: BoundaryPolicy = BoundaryPolicy(), strategy: Strategy = adaptive_gap) -> DataFrame:
    """pool with accepted and reason; the floor comes after the strategy."""
    low = F.col("similarity") < policy.quality_floor
    rows = strategy(pool, policy)
    reason = F.when(low, "quality-floor").when(F.col("selected"), "accepted").otherwise("strategy-boundary")
    return rows.withColumn("accepted", F.col("selected") & ~low).withColumn("reason", reason)
