"""Ranking evaluation of relations: precision, nDCG, calibration, reviews, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.policy import ScorePolicy
from .relations import combine

RELEVANT = 2
GRID = (0.2, 0.35, 0.5, 0.65)


def cosine_strength(cosine: Column, low: Column, high: Column) -> Column:
    return F.when(cosine.isNull() | (cosine < low), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine - low) / (high - low))))


def method_score(method: str, low: Column, high: Column, policy: ScorePolicy = ScorePolicy()) -> Column:
    semantic = cosine_strength(F.col("cosine"), low, high)
    if method == "mention-explicit":
        return combine(F.col("mention"), F.col("explicit"), F.lit(0.0), policy)
    if method == "semantic":
        return semantic
    return combine(F.col("mention"), F.col("explicit"), semantic, policy)


def per_center(graded: DataFrame, score: Column, k: int = 3, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """Per center (and ``by``): relevant, p_at_k (over k, always), oracle_p, ndcg, shown, irrelevant.

    graded: node_a, node_b, grade and what the score needs; only scores over 0 are ranked.
    """
    ends = F.explode(F.array(F.struct(F.col("node_a").alias("center"), F.col("node_b").alias("other")), F.struct(F.col("node_b").alias("center"), F.col("node_a").alias("other"))))
    rows = graded.withColumn("score", score).withColumn("_e", ends).select(*by, F.col("_e.center").alias("center"), F.col("_e.other").alias("other"), "grade", "score", "hard_negative")
    keys = [*by, "center"]
    rank = F.when(F.col("score") > 0, F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.when(F.col("score") > 0, F.col("score")).otherwise(-1.0)), "other")))
    ideal = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("grade"), "other"))
    rows = rows.withColumn("rank", rank).withColumn("ideal", ideal)
    gain = lambda place: F.coalesce(F.sum(F.when(F.col(place) <= k, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(place) + 1.0))), F.lit(0.0))
    good = F.col("grade") >= RELEVANT
    return (
        rows.groupBy(*keys)
        .agg(F.count_if(good).alias("relevant"), (F.count_if(good & (F.col("rank") <= k)) / F.lit(k)).alias("p_at_k"), (F.least(F.count_if(good), F.lit(k)) / F.lit(k)).alias("oracle_p"), gain("rank").alias("_dcg"), gain("ideal").alias("_ideal"), F.count_if(F.col("score") >= threshold).alias("shown"), F.count_if((F.col("score") >= threshold) & ~good).alias("irrelevant"))
        .withColumn("ndcg", F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")).otherwise(F.lit(0.0)))
        .drop("_dcg", "_ideal")
    )


def summarize(centers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over the centers with relevant answers; of the others the share that shows something."""
    has = F.col("relevant") > 0
    mean = lambda c: F.round(F.avg(F.when(has, F.col(c))), 9)
    zero = F.coalesce(F.round(F.avg(F.when(~has, (F.col("shown") > 0).cast("double"))), 9), F.lit(0.0))
    return centers.groupBy(*by).agg(F.count_if(has).alias("centers"), mean("p_at_k").alias("p_at_k"), mean("oracle_p").alias("oracle_p"), mean("ndcg").alias("ndcg"), zero.alias("zero_shown"))


def calibrate(graded: DataFrame, high: float = 0.9, k: int = 3, threshold: float = 0.5) -> DataFrame:
    """One row per minimum of the grid with its objective, best first, ties to the lower minimum; dev labels only."""
    if not graded.where("split <> 'dev'").isEmpty():
        raise ValueError("calibration takes development labels only")
    grid = graded.withColumn("low", F.explode(F.array(*map(F.lit, GRID))))
    score = method_score("hybrid", F.col("low"), F.lit(high))
    totals = summarize(per_center(grid, score, k, threshold, ("low",)), ("low",))
    hard = grid.groupBy("low").agg(F.coalesce(F.avg(F.when(F.col("hard_negative"), (score >= threshold).cast("double"))), F.lit(0.0)).alias("hard"))
    objective = F.round(F.col("ndcg") + 0.5 * F.col("p_at_k") - 0.5 * F.col("hard") - 0.25 * F.col("zero_shown"), 9)
    return totals.join(hard, "low").select("low", "ndcg", "p_at_k", objective.alias("objective")).orderBy(F.desc("objective"), "low")


def review_summary(reviews: DataFrame) -> DataFrame:
    """(verdict, reviews, notes) of human reviews (verdict, note); unknown verdicts are invalid."""
    verdict = F.when(F.col("verdict").isin("useful", "weak", "wrong"), F.col("verdict")).otherwise("invalid")
    return reviews.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("reviews"), F.count_if(F.coalesce(F.trim("note"), F.lit("")) != "").alias("notes"))


def review_queue(ranked: DataFrame, size: int = 40, per_node: int = 3, pool: int = 4000) -> DataFrame:
    """The first pairs by score in which no node appears more than ``per_node`` times: a greedy pass over the ranking.

    The ranking is read in blocks of ``pool`` pairs, the next without the nodes that are used up, until the queue is full or pairs
    end. The first pair of a block is always taken, so there are no more than ``size`` + 1 blocks.
    The pairs are kept on the executors between blocks, so what they come from is computed once.
    """
    pairs = ranked.select("node_a", "node_b", "score").persist()
    used: dict[str, int] = {}
    out, rest = [], pairs
    while len(out) < size:
        block = rest.orderBy(F.desc("score"), "node_a", "node_b").limit(pool).collect()  # of ``pool`` rows
        for a, b, s in block:
            if len(out) < size and used.get(a, 0) < per_node and used.get(b, 0) < per_node:
                used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
                out.append((a, b, s))
        if len(block) < pool:
            break
        a, b, s = block[-1]
        full = [n for n, k in used.items() if k >= per_node]
        after = (F.col("score") < s) | ((F.col("score") == s) & ((F.col("node_a") > a) | ((F.col("node_a") == a) & (F.col("node_b") > b))))
        rest = pairs.where(after & ~F.col("node_a").isin(full) & ~F.col("node_b").isin(full))
    pairs.unpersist()
    return ranked.sparkSession.createDataFrame(out, "node_a string, node_b string, score double")


def nearest_rank(samples: DataFrame, group: str, value: str, shares: tuple[float, ...] = (0.5, 0.95), parts: int = 200) -> DataFrame:
    """Percentiles by nearest rank, and the maximum, of each group; nulls count as the smallest values.

    No task sorts a group: approximate quantiles cut its values into ``parts`` ranges, which are
    counted; only the ranges that hold a wanted rank are ranked, equal values counted first.
    """
    cuts = samples.groupBy(group).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10 * parts).alias("_cuts"), F.count("*").alias("_all"), F.max(value).alias("max"))
    range_of = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(-1)).cast("int")
    dealt = samples.select(F.col(group), F.col(value)).join(cuts.select(F.col(group).alias("_g"), "_cuts"), F.col(group).eqNullSafe(F.col("_g"))).select(group, value, F.when(F.col(value).isNull(), -1).otherwise(range_of).alias("_range"))
    sizes = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    upto = sizes.withColumn("_upto", F.sum("_n").over(W.partitionBy(group).orderBy("_range")))  # some ``parts`` rows a group
    want = F.explode(F.array(*(F.struct(F.lit(f"p{round(100 * s)}").alias("name"), F.greatest(F.ceil(F.col("_all") * F.lit(s)), F.lit(1)).alias("rank")) for s in shares)))
    asked = upto.join(cuts.select(F.col(group).alias("_g"), "_all"), F.col(group).eqNullSafe(F.col("_g"))).select(group, "_range", "_n", "_upto", want.alias("w")).where("w.rank <= _upto and w.rank > _upto - _n")
    asked = asked.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.col("w.name").alias("_name"), (F.col("w.rank") - (F.col("_upto") - F.col("_n"))).alias("_place"))
    near = dealt.groupBy(group, "_range", value).agg(F.count("*").alias("_n")).join(asked, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    ranked = near.withColumn("_upto", F.sum("_n").over(W.partitionBy(group, "_range", "_name").orderBy(F.asc_nulls_first(value)))).where("_place <= _upto and _place > _upto - _n")
    found = ranked.groupBy(group).agg(*(F.max(F.when(F.col("_name") == f"p{round(100 * s)}", F.col(value))).alias(f"p{round(100 * s)}") for s in shares))
    return cuts.select(F.col(group).alias("_g"), "max").join(found, F.col(group).eqNullSafe(F.col("_g")), "left").select(F.col("_g").alias(group), *(f"p{round(100 * s)}" for s in shares), "max")
