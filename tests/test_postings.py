"""The stored search index against a database's own full-text search, and its plans."""

import random
import re
import sqlite3

import pytest

from quillgraph.operators.ingest import Conflict
from quillgraph.operators.postings import SearchIndex, query_phrases

SCHEMA = "doc string, title string, body string"
WORDS = ["alpha", "béta", "Gamma", "delta", "epsilon", "zeta-eta", "x9", "C3PO", "naïve", "Ünder"]


def by_database(rows, query, limit):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, title, body, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t VALUES (?,?,?)", [(i, t or "", b or "") for i, t, b in rows])
    words = " AND ".join(f'"{w}"' for w in query.split())
    return [(i, round(-s, 6)) for i, s in con.execute("SELECT id, bm25(t, 0, 3, 1) AS r FROM t WHERE t MATCH ? ORDER BY round(r, 9), id LIMIT ?", (words, limit))]


def texts(rng, n):
    sep = lambda: rng.choice([" ", " ", ", ", "\n", "_"])
    text = lambda k: "".join(rng.choice(WORDS) + sep() for _ in range(rng.randint(0, k)))
    return [(f"d{i:03d}", text(3), text(40)) for i in range(n)]


def found(index, query, limit=20):
    return [(r.doc, round(r.score, 6)) for r in index.search(query, limit).collect()]


def test_updates_deletes_and_merge_against_a_database(spark, tmp_path):
    rng = random.Random(6)
    rows = {r[0]: r for r in texts(rng, 80)}
    rows["null"] = ("null", None, None)
    index = SearchIndex(spark, str(tmp_path / "i"), buckets=8, spread=2)
    asked = ["alpha", "BETA gamma", "under naive", "zeta_eta", "c3po x9 delta", "nothing", "alpha nothing"]
    same = lambda: all(found(index, q) == by_database(rows.values(), q, 20) for q in asked)
    index.update(spark.createDataFrame(list(rows.values()), SCHEMA).repartition(3))
    assert same()
    changed = [(f"d{i:03d}", "Alpha", "beta gamma only") for i in range(0, 30, 3)] + [("new1", "x9", "delta c3po x9")]
    index.update(spark.createDataFrame(changed, SCHEMA), spark.createDataFrame([("d001",), ("d004",), ("unknown",)], "doc string"))
    rows |= {r[0]: r for r in changed}
    del rows["d001"], rows["d004"]
    assert same()
    index.update(spark.createDataFrame([("d001", "back", "alpha alpha")], SCHEMA), spark.createDataFrame([("d003",)], "doc string"))
    rows["d001"] = ("d001", "back", "alpha alpha")
    del rows["d003"]
    assert same()
    before = [found(index, q, 1000) for q in asked]
    index.merge()
    assert [found(index, q, 1000) for q in asked] == before and same()
    assert len([t for t in index.store.tables() if t.startswith("postings")]) == 1


def test_words_inside_runs_of_characters_without_spaces(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "c"), buckets=4)
    index.update(spark.createDataFrame([("a", "海边小镇", "夏季潮汐改变灯塔航线 GPS导航"), ("b", "港口", "潮汐 改变 カメラ"), ("c", "x", "灯 塔")], SCHEMA))
    ids = lambda q: sorted(r.doc for r in index.search(q).collect())
    assert ids("季潮汐") == ["a"] and ids("潮汐") == ["a", "b"] and ids("汐") == ["a", "b"] and ids("灯塔") == ["a"]
    assert ids("导航") == ["a"] and ids("gps导航") == ["a"] and ids("导航 海边") == ["a"] and ids("雪山") == [] and ids("カメ") == ["b"]
    index.update(spark.createDataFrame([("a", "Rewritten", "only other things now")], SCHEMA))
    assert ids("季潮汐") == [] and ids("rewritten") == ["a"]
    assert query_phrases("a语") == [[(0, "a"), (1, "语")]] and query_phrases("中") == [[(0, "中")]]


def test_a_query_reads_its_terms_folders_alone(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "p"), buckets=16)
    index.update(spark.createDataFrame(texts(random.Random(1), 20), SCHEMA))
    plan = index.matches("alpha")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", plan) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(term,alpha\)", plan)
    assert "ReadSchema: struct<term:string,doc:string,field:int,size:int,places:array<int>>" in plan


def test_one_of_two_writers_wins_and_empty_tables(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "w"), buckets=4)
    none = spark.createDataFrame([], SCHEMA)
    assert found(index, "alpha") == []
    index.update(none)
    assert found(index, "alpha") == [] and index.generation() == 1
    index.update(spark.createDataFrame([("a", "Harbour", "lanterns")], SCHEMA), expected=1)
    with pytest.raises(Conflict):
        index.update(spark.createDataFrame([("b", "Quay", "ropes")], SCHEMA), expected=1)
    assert found(index, "ropes") == [] and found(index, "lanterns")[0][0] == "a"
    for bad in ("", " ", "x" * 513):
        with pytest.raises(ValueError):
            index.search(bad)
    docs = spark.createDataFrame([("a", "Harbour", "y" * 200 + " Lanterns " + "z" * 200)], SCHEMA)
    hit = index.hits(docs, "lanterns").first()
    assert hit.offset == 201 and "Lanterns" in hit.excerpt and len(hit.excerpt) == 80 + 8 + 120
