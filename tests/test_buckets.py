"""Guarded writes: expected hashes, conflicts as rows, touched buckets only."""

import hashlib
import random

import pytest

from quillgraph.operators.ingest import Buckets, Conflict, Store

SCHEMA = "key string, value string, expected_hash string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def put(spark, buckets, rows, expected=None):
    generation, out = buckets.put(spark.createDataFrame(rows, SCHEMA).repartition(2), expected)
    return generation, sorted(((r.key or "", r.outcome, r.hash, r.version) for r in out.collect()), key=str)


def test_two_writers_one_wins(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one, two = Buckets(store, buckets=4), Buckets(Store(spark, str(tmp_path / "s")), buckets=4)
    assert put(spark, one, [("a", "1", None), ("b", "1", None)]) == (1, [("a", "written", sha("1"), 1), ("b", "written", sha("1"), 1)])
    assert put(spark, one, [("a", "left", sha("1"))])[0] == 2
    assert put(spark, two, [("a", "right", sha("1")), ("b", "2", sha("1"))]) == (3, [("a", "conflict", sha("left"), 2), ("b", "written", sha("2"), 2)])
    with pytest.raises(Conflict):
        put(spark, two, [("a", "late", sha("left"))], expected=2)
    with pytest.raises(Conflict):
        put(spark, two, [("a", "late", sha("other"))], expected=2)
    assert {r.key: r.value for r in one.read().collect()} == {"a": "left", "b": "2"}


def test_only_touched_buckets_are_written(spark, tmp_path):
    buckets = Buckets(Store(spark, str(tmp_path / "s")), buckets=16)
    put(spark, buckets, [(f"k{i}", str(i), None) for i in range(40)])
    before = buckets._paths()
    put(spark, buckets, [("k3", "new", sha("3")), ("k4", "4", sha("4")), ("k5", "x", None)])
    after = buckets._paths()
    assert sum(before[b] != after[b] for b in before) == 1 and before.keys() == after.keys()
    assert put(spark, buckets, [("k4", "4", sha("4"))])[0] == 2, "nothing written, nothing published"


def test_random_batches_against_a_dictionary(spark, tmp_path):
    rng = random.Random(7)
    buckets, live = Buckets(Store(spark, str(tmp_path / "s")), buckets=3), {}
    for _ in range(5):
        rows = [(rng.choice([None, *"abcdef"]), rng.choice([None, "x", "y", ""]), rng.choice([None, sha("x"), sha("y"), sha("")])) for _ in range(7)]
        keys = [k for k, _, _ in rows]
        want = []
        changed = {}
        for k, v, e in rows:
            now, version = live.get(k, (None, 0))
            if k is None or keys.count(k) > 1 or (None if now is None else sha(now)) != e:
                want.append((k or "", "conflict", None if now is None else sha(now), version))
            elif v is None:
                want.append((k, "unchanged" if now is None else "deleted", None, version))
                changed[k] = None
            elif v == now:
                want.append((k, "unchanged", sha(v), version))
            else:
                want.append((k, "written", sha(v), version + 1))
                changed[k] = (v, version + 1)
        assert sorted(put(spark, buckets, rows)[1], key=str) == sorted(want, key=str)
        for k, v in changed.items():
            live.pop(k, None) if v is None else live.update({k: v})
        assert {r.key: (r.value, r.version) for r in buckets.read().collect()} == live
