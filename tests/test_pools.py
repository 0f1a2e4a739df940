import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillgraph.functions.policy import Retrieval
from quillgraph.operators import boundary, vectors


def corpus(seed=5, docs=23):
    """Documents of one to five units with few different vectors, so that many similarities are equal."""
    rng, rows = random.Random(seed), []
    for d in range(docs):
        for k in range(rng.randint(1, 5)):
            v = [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)] + [1.0]
            n = math.sqrt(sum(x * x for x in v))
            rows.append((f"u{d:02d}{k}", f"d{d:02d}", str(rng.randint(0, 2)), [x / n for x in v]))
    rng.shuffle(rows)
    return rows


def mean_of_matches(left, right, matches):
    pairs = sorted(((-float(np.clip(np.einsum("d,d->", np.array(a[3]), np.array(b[3])), -1, 1)), a[0] + b[0], a[2], b[2]) for a in left for b in right), key=lambda x: x[:2])
    taken, used = [], (set(), set())
    for s, _, x, y in pairs:
        if x not in used[0] and y not in used[1] and len(taken) < matches:
            used[0].add(x)
            used[1].add(y)
            taken.append(-s)
    return sum(taken) / len(taken)


def test_pools_against_brute_force_with_ties_in_small_and_large_blocks(spark):
    rows = corpus()
    of = {d: sorted(g) for d, g in itertools.groupby(sorted(rows, key=lambda r: r[1]), key=lambda r: r[1])}
    u = spark.createDataFrame(rows, "unit string, doc string, section string, vector array<double>").repartition(3)
    for name, matches in (("max", 1), ("top-mean", 3)):
        for budget, block in ((4, 7), (100, 2048)):
            got = {(r.center, r.neighbor): (round(r.similarity, 9), r.rank) for r in vectors.semantic_pool(u, Retrieval(budget=budget, aggregation=name), block).collect()}
            want = {}
            for c in of:
                best = sorted((-mean_of_matches(of[c], of[d], matches), d) for d in of if d != c)[:budget]
                want |= {(c, d): (round(-s, 9), k) for k, (s, d) in enumerate(best, 1)}
            assert got == want, name


def test_units_are_sent_to_a_number_of_tasks_that_does_not_grow_with_them(spark):
    cores = spark.sparkContext.defaultParallelism
    assert vectors._tasks(spark, 120_000, vectors.BLOCK) == vectors._tasks(spark, 400_000, vectors.BLOCK) == 2 * cores
    assert vectors._tasks(spark, 0, 10) == 1 and vectors._tasks(spark, 1_000_001, 10) == 100_001


def test_asked_cosines_from_a_least_value_on(spark):
    rows = [(f"u{i}", [math.cos(i), math.sin(i)]) for i in range(9)]
    u = spark.createDataFrame(rows, "unit string, vector array<double>")
    got = {(r.unit_a, r.unit_b) for r in vectors.asked_cosines(u.where("unit < 'u3'"), u, 2, least=0.5).collect()}
    assert got == {(f"u{a}", f"u{b}") for a in range(3) for b in range(9) if a != b and math.cos(a - b) >= 0.5}


def test_the_cut_computes_its_pool_once(spark):
    pool = spark.range(40).select(F.lit("c").alias("center"), F.col("id").cast("string").alias("neighbor"), (1 - F.col("id") / 100).alias("similarity"), (F.col("id") + 1).cast("int").alias("rank"))
    for rows in (boundary.diagnostics(pool), boundary.decisions(pool)):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
