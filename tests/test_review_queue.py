from pyspark.sql import functions as F

from quillgraph.operators import evaluation
from quillgraph.plans import queries


def brute(pairs, size=40, per_node=3):
    used, out = {}, []
    for a, b, s in sorted(pairs, key=lambda r: (-r[2], r[0], r[1])):
        if len(out) < size and max(used.get(a, 0), used.get(b, 0)) < per_node:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            out.append((a, b, s))
    return out


def test_queue_goes_on_past_the_first_block(spark):
    pairs = [("hub", f"n{i:03}", 1.0 - i / 1000) for i in range(100)] + [(f"p{i:03}", f"q{i:03}", 0.5 if i % 2 else 0.4) for i in range(60)]
    got = evaluation.review_queue(spark.createDataFrame(pairs, "node_a string, node_b string, score double"), pool=10)
    assert [tuple(r) for r in got.collect()] == brute(pairs) and got.count() == 40


def test_pairs_of_either_ends_pool(spark, monkeypatch):
    pool = [("b", "a", 0.9), ("a", "c", 0.8), ("c", "a", 0.8)]
    made = spark.createDataFrame(pool, "center string, neighbor string, similarity double").withColumn("rank", F.lit(1))
    monkeypatch.setattr(queries, "_pool", lambda *_: made)
    assert [tuple(r) for r in queries.review_queue(spark, "").collect()] == [("a", "b", 0.9), ("a", "c", 0.8)]


def test_what_the_pairs_come_from_is_computed_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(parts):
        for p in parts:
            read.add(len(p))
            yield p

    pairs = [(f"p{i:03}", f"q{i:03}", i / 100) for i in range(90)]
    kept = spark.createDataFrame(pairs, "node_a string, node_b string, score double").mapInPandas(count, "node_a string, node_b string, score double")
    assert len(evaluation.review_queue(kept, pool=10).collect()) == 40 and read.value == 90
