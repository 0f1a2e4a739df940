"""Frozen snapshots, their invariants, semantic states and overrides."""

from pyspark.sql import functions as F

from quillgraph.operators import explore, ingest, relations, vectors


def centered(spark):
    rows = [("a", "b", 0.5), ("a", "c", 0.3), ("b", "c", 0.8)]
    pairs = spark.createDataFrame([(a, b, s, False, False) for a, b, s in rows], "node_a string, node_b string, score double, hidden boolean, pinned boolean")
    return relations.by_center(pairs)


def test_freeze_store_and_validity(spark, tmp_path):
    live = spark.createDataFrame([(d, 1, 1) for d in "abc"], "doc string, revision long, epoch long")
    tables = explore.freeze(centered(spark), spark.createDataFrame([("a",)], "doc string"), live, 50, None, 7, 3, "v1")
    store = ingest.Store(spark, str(tmp_path / "s"))
    store.commit(tables, 0)
    heads, rel, cross = (store.read(t) for t in ("snapshots", "snapshot_relations", "snapshot_cross"))
    h = heads.first()
    assert (h.focus, h.budget, h.low, h.high) == ("a", 2, 0.3, 0.5)
    assert [(r.node_a, r.node_b, r.score) for r in cross.collect()] == [("b", "c", 0.8)]
    assert explore.snapshot_faults(heads, rel, cross).count() == 0
    assert {r.fault for r in explore.snapshot_faults(heads.withColumn("schema_version", F.lit(1)), rel.withColumn("score", F.lit(2.0)), cross.withColumn("node_b", F.lit("z"))).collect()} == {"header", "score", "cross relation outside the neighborhood"}
    moved = live.withColumn("epoch", F.when(F.col("doc") == "b", 2).otherwise(1))
    assert {(r.neighbor, r.valid) for r in explore.still_valid(rel, moved).collect()} == {("b", False), ("c", True)}
    assert explore.snapshot_status(heads, live, 7, 4).first().reasons == "user-declarations-changed"


def test_evidence_states(spark):
    docs = spark.createDataFrame([("d", 1, "hello world")], "doc string, revision long, markdown string")
    sections = spark.createDataFrame([("d", "s", 0, 11)], "doc string, section string, s int, e int")
    loc = spark.createDataFrame([("d", 1, "s", 0, 5), ("d", 2, "s", 0, 5), ("x", 1, "s", 0, 5), ("d", 1, "s", 9, 12)], "doc string, revision long, section string, start int, end int")
    assert sorted((r.status, r.text) for r in explore.read_evidence(loc, docs, sections).collect() if r.text) == [("valid", "hello")]
    assert sorted(r.status for r in explore.read_evidence(loc, docs, sections).collect()) == ["invalid", "missing", "stale", "valid"]


def test_pair_states_and_signals(spark):
    status = spark.createDataFrame([("a", "ready"), ("b", "ready"), ("c", "stale"), ("d", "error")], "doc string, status string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("a", "z")], "node_a string, node_b string")
    assert {r.node_b: r.state for r in vectors.pair_state(pairs, status, "s").collect()} == {"b": "not-recalled", "c": "stale", "d": "error", "z": "pending"}
    assert {r.state for r in vectors.pair_state(pairs, status, None).collect()} == {"not-configured"}
    signals = spark.createDataFrame([("x", "s", "u1", "h1"), ("x", "s", "u2", "h2"), ("y", "s", "u1", "old"), ("z", "t", "u1", "h1")], "signal string, space string, unit string, content_hash string")
    units = spark.createDataFrame([("u1", "h1"), ("u2", "h2")], "unit string, content_hash string")
    assert {r.signal: r.valid for r in vectors.signals_valid(signals, units, "s").collect()} == {"x": True, "y": False, "z": False}


def test_coverage_of_an_empty_corpus_is_ready(spark):
    none = spark.createDataFrame([], "doc string, revision long, status string, units long, ready long")
    assert vectors.coverage(none).first().status == "ready"


def test_overrides_merge(spark):
    schema = "node_a string, node_b string, hidden boolean, pinned boolean, note string"
    now = spark.createDataFrame([("a", "b", True, False, None), ("a", "c", False, True, "n")], schema)
    change = spark.createDataFrame([("b", "a", False, None, None), ("c", "a", None, None, "m"), ("d", "d", True, None, None)], schema)
    assert [(r.node_a, r.node_b, r.pinned, r.note) for r in relations.merge_overrides(now, change).collect()] == [("a", "c", True, "m")]
