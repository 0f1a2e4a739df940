r"""Mixing sources to target weights by hierarchical budgeting.

The leaves of a domain - language - source tree hold tokens. A budget flows down by the
weights of siblings; a node that cannot use its part (its tokens times the allowed epochs)
is filled, and what it leaves goes to its siblings by weight. Only when all siblings are
full does a shortage reach the parent's level, as subtrees' capacities bound the parents'
own shares. Each leaf then takes whole seeded epochs and a token-prefix of one more.

All of it is DataFrame operations. The order inside a leaf is a hash; its first digits cut
every leaf, a hot one too, into slices whose sums are added up first, so no task ever holds
a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Recipe:
    """Integer weights by level and name (1 where none is given; 0 takes nothing), and the budget as a share of all tokens."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    #: Budget = all tokens * numerator // denominator.
    numerator: int = 1
    denominator: int = 2
    epochs: int = 2
    seed: str = "mix-1"
    #: Take the document that the prefix ends in as a whole.
    whole: bool = False


#: Slices of a leaf: hash values of so many hexadecimal digits.
SLICE_DIGITS = 3

#: The mix of the registered query: domains are the sources' numbers modulo 3.
DEFAULT = Recipe({"domain": {"d0": 5, "d1": 3, "d2": 2}, "lang": {"en": 4, "fr": 2, "de": 2, "es": 2}})


def domain_of(source: Column) -> Column:
    """The default domain: the number in the source's name modulo 3, or ``other``."""
    digits = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})", 1)
    return F.when(digits == "", "other").otherwise(F.concat(F.lit("d"), (F.when(digits == "", 0).otherwise(digits).cast("int") % 3).cast("string")))


def token_count(text: Column) -> Column:
    r"""Words ``[^\x20\x09-\x0D]+`` of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weight(recipe: Recipe, level: str) -> Column:
    given = recipe.weights.get(level, {})
    out = F.lit(1).cast("long")
    for name, w in sorted(given.items()):
        out = F.when(F.col(level) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def _fill(parents: DataFrame, leaves: DataFrame, above: list[str], level: str, recipe: Recipe) -> DataFrame:
    """Shares of the children of each parent: the level l at which min(capacity, l * weight) adds up to the parent's share."""
    keys = [*above, level]
    nodes = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("w", _weight(recipe, level))
    nodes = nodes.where("w > 0 and capacity > 0").withColumn("r", F.col("capacity").cast("double") / F.col("w"))
    nodes = nodes.join(parents, above) if above else nodes.crossJoin(parents)  # the root is one row
    order = W.partitionBy(*above, "share").orderBy("r", level)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    nodes = nodes.withColumn("full", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("left", F.sum("w").over(W.partitionBy(*above, "share")) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    nodes = nodes.withColumn("l", (F.col("share") - F.col("full")) / F.col("left"))
    # The first child that the level does not fill sets the level of the rest; without one all are full.
    level_at = F.min(F.when(F.col("l") <= F.col("r"), F.struct("r", level, "l"))).over(W.partitionBy(*above, "share"))
    nodes = nodes.withColumn("set", level_at["l"])
    part = F.when(F.col("set").isNull(), F.col("capacity").cast("double")).otherwise(F.least(F.col("capacity").cast("double"), F.col("set") * F.col("w")))
    return nodes.select(*keys, part.alias("share"))


def budgets(leaves: DataFrame, recipe: Recipe) -> DataFrame:
    """Whole tokens to take of each leaf. leaves: the LEVELS and tokens."""
    caps = leaves.withColumn("capacity", F.col("tokens") * recipe.epochs)
    part = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * recipe.numerator / recipe.denominator).cast("double").alias("share"))
    for k, level in enumerate(LEVELS):
        part = _fill(part, caps, list(LEVELS[:k]), level, recipe)
    return part.select(*LEVELS, F.floor(F.col("share") + 1e-6).cast("long").alias("target"))


def choose(docs: DataFrame, recipe: Recipe = DEFAULT) -> DataFrame:
    """The rows to train on: doc_id, domain, lang, source, epoch (from 0), n_tokens, take.

    docs: doc_id, n_tokens, domain, lang, source; other columns are ignored. Nulls in the three
    levels are the name ``""``; documents without tokens are never taken; a null doc_id is
    ordered by the empty text; repeated rows are taken one by one. take: the tokens to use from
    the document's start, n_tokens in whole epochs. An empty table gives no rows.
    """
    shared.ready(docs.sparkSession)
    # Cut here: texts are counted once, though rows are read twice.
    rows = docs.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in LEVELS)).where("n_tokens > 0").checkpoint()
    # Cut twice more, at a row a leaf: a plan of all levels at once is planned anew at each of its stages, in the driver's memory.
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).checkpoint()
    plan = leaves.join(budgets(leaves, recipe), list(LEVELS)).select(*LEVELS, F.floor(F.col("target") / F.col("tokens")).cast("long").alias("cycles"), F.pmod("target", "tokens").alias("rest")).checkpoint()
    shared.settle(docs.sparkSession)
    rows = rows.join(plan, list(LEVELS))
    order = F.md5(F.concat_ws(":", F.lit(recipe.seed), F.col("cycles").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("place", order).withColumn("slice", F.substring("place", 1, SLICE_DIGITS))
    slices = rows.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("own"))
    slices = slices.withColumn("base", F.sum("own").over(W.partitionBy(*LEVELS).orderBy("slice")) - F.col("own")).drop("own")
    inside = W.partitionBy(*LEVELS, "slice").orderBy("place", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("n_tokens").over(inside)).join(slices, [*LEVELS, "slice"])
    start = F.col("base") + F.col("upto") - F.col("n_tokens")
    part = F.least(F.greatest(F.col("rest") - start, F.lit(0)), F.col("n_tokens"))
    if recipe.whole:
        part = F.when(part > 0, F.col("n_tokens")).otherwise(0)
    rows = rows.withColumn("part", part).where("cycles > 0 or part > 0")
    last = F.when(F.col("part") > 0, F.col("cycles")).otherwise(F.col("cycles") - 1)
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return rows.select("doc_id", *LEVELS, "epoch", "n_tokens", F.when(F.col("epoch") < F.col("cycles"), F.col("n_tokens")).otherwise(F.col("part")).alias("take"))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the levels of a documents table."""
    return docs.select("doc_id", token_count(F.col("text")).alias("n_tokens"), domain_of(F.col("source")).alias("domain"), "lang", "source")


def keep_mix(docs: DataFrame, recipe: Recipe) -> DataFrame:
    """The documents that the mix takes, whole and once, with all their columns.

    One epoch at most, so that nothing repeats; rows without doc_id are not taken.
    """
    if recipe.epochs != 1 or not recipe.whole:
        raise ValueError("only whole documents of one epoch can be kept")
    taken = choose(counted(docs.where("doc_id is not null")), recipe).select("doc_id").distinct()
    return docs.join(taken, "doc_id", "left_semi").select(*docs.columns)


def _fill_sql(level: int, recipe: Recipe) -> str:
    above, name = LEVELS[:level], LEVELS[level]
    keys = ", ".join((*above, name))
    own = "".join(f"{c}, " for c in above)
    by = ", ".join((*above, "share"))
    weight = "".join(f" WHEN {name} = '{k}' THEN {v}" for k, v in sorted(recipe.weights.get(name, {}).items()))
    weight = f"CASE{weight} ELSE 1 END" if weight else "1"
    on = f"JOIN part{level} USING ({', '.join(above)})" if above else "CROSS JOIN part0"
    return f"""node{level} AS (
  SELECT *, CAST(capacity AS DOUBLE) / w AS r FROM (SELECT {keys}, CAST(sum(tokens) * {recipe.epochs} AS BIGINT) AS capacity, CAST({weight} AS BIGINT) AS w FROM leaf GROUP BY {keys}) {on} WHERE w > 0 AND capacity > 0),
sum{level} AS (SELECT *, CAST(coalesce(sum(capacity) OVER b, 0) AS DOUBLE) AS full_, CAST(sum(w) OVER (PARTITION BY {by}) - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS left_ FROM node{level}
  WINDOW b AS (PARTITION BY {by} ORDER BY r, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
set{level} AS (SELECT *, first_value(CASE WHEN (share - full_) / left_ <= r THEN (share - full_) / left_ END) OVER (PARTITION BY {by} ORDER BY CASE WHEN (share - full_) / left_ <= r THEN 0 ELSE 1 END, r, {name}) AS l FROM sum{level}),
part{level + 1} AS (SELECT {own}{name}, CASE WHEN l IS NULL THEN CAST(capacity AS DOUBLE) ELSE least(CAST(capacity AS DOUBLE), l * w) END AS share FROM set{level})"""


def oracle(recipe: Recipe = DEFAULT) -> str:
    """DuckDB SQL for choose(counted(documents), recipe)."""
    levels = ", ".join(LEVELS)
    part = "CASE WHEN part_ > 0 THEN n_tokens ELSE 0 END" if recipe.whole else "part_"
    return f"""
WITH doc AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens,
    CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})', 1) = '' THEN 'other' ELSE 'd' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})', 1) AS BIGINT) % 3 AS VARCHAR) END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents),
row_ AS (SELECT * FROM doc WHERE n_tokens > 0),
leaf AS (SELECT {levels}, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM row_ GROUP BY {levels}),
part0 AS (SELECT CAST(floor(CAST(coalesce(sum(tokens), 0) * {recipe.numerator} AS DOUBLE) / {recipe.denominator}) AS DOUBLE) AS share FROM leaf),
{", ".join(_fill_sql(k, recipe) for k in range(len(LEVELS)))},
plan AS (SELECT {levels}, CAST(floor(share + 1e-6) AS BIGINT) // tokens AS cycles, CAST(floor(share + 1e-6) AS BIGINT) % tokens AS rest FROM leaf JOIN part3 USING ({levels})),
placed AS (SELECT *, md5('{recipe.seed}:' || CAST(cycles AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM row_ JOIN plan USING ({levels})),
upto AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY {levels} ORDER BY place, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - n_tokens AS start FROM placed),
taken AS (SELECT *, {part} AS part FROM (SELECT *, least(greatest(rest - start, 0), n_tokens) AS part_ FROM upto))
SELECT doc_id, {levels}, epoch, n_tokens, CAST(CASE WHEN epoch < cycles THEN n_tokens ELSE part END AS BIGINT) AS take
FROM (SELECT *, unnest(range(0, CASE WHEN part > 0 THEN cycles + 1 ELSE cycles END)) AS epoch FROM taken)
"""
