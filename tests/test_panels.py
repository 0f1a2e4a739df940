"""Indexing, export, pages and packed evidence."""

import pytest

from quillgraph.operators import export, indexing, panels


def test_index_reuses_discards_and_isolates_errors(spark):
    class Flaky:
        dimensions = 2

        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return [[1.0, 0.0] for _ in texts]

    units = spark.createDataFrame([("a", "u1", "h1", "x", 1, 1), ("b", "u2", "h2", "bad", 1, 1), ("c", "u3", "h3", "y", 1, 1), ("d", "u4", "h4", "z", 1, 2), ("d", "u5", "h5", "z", 1, 1)], "doc string, unit string, content_hash string, text string, revision long, sequence int").coalesce(1)
    stored = spark.createDataFrame([("a", "h1", [0.0, 1.0])], "doc string, content_hash string, vector array<double>")
    live = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 1)], "doc string, revision long")
    got = {r.unit: (r.action, r.vector, r.error) for r in indexing.index(units.repartition(5, "unit"), stored, live, Flaky()).collect()}
    assert got["u1"] == ("reuse", [0.0, 1.0], None) and got["u3"][0] == got["u5"][0] == "discard"
    assert got["u2"][1] is None and got["u2"][2] == "no"
    assert got["u4"] == ("encode", [1.0, 0.0], None)


@pytest.mark.parametrize("parts", [1, 2, 5])
@pytest.mark.parametrize("bad", range(7))
def test_one_bad_text_fails_alone_however_units_lie(spark, parts, bad):
    class Flaky:
        dimensions, seen = 2, []

        def embed(self, texts):
            if "bad" in texts:
                raise ValueError("no")
            assert len({t[0] for t in texts}) == 1, "a batch spans documents"
            return [[1.0, 0.0] for _ in texts]

    rows = [(d, f"{d}{k}", f"{d}{k}") for d in "pq" for k in range(3)] + [("r", "r0", "r0")]
    rows[bad] = (*rows[bad][:2], "bad")
    units = spark.createDataFrame(rows, "doc string, unit string, text string").repartition(parts)
    got = {r.unit: (r.vector, r.error) for r in indexing.encode(units, Flaky(), delay=0).collect()}
    assert got == {u: (None, "no") if t == "bad" else ([1.0, 0.0], None) for _, u, t in rows}


def test_retry_is_only_for_passing_failures():
    calls = []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return [[1.0]]

    assert indexing.with_retry(call, 2, 0) == [[1.0]] and len(calls) == 3
    with pytest.raises(TimeoutError):
        calls.clear()
        indexing.with_retry(call, 1, 0)


def test_export_rewrites_links_and_fails_closed(spark):
    docs = spark.createDataFrame([("a", "a.md", "see [[B|bee]] and [[P|pea]]"), ("b", "b.md", "text"), ("p", "p.md", "private")], "doc string, path string, markdown string")
    links = spark.createDataFrame([("a", "[[B|bee]]", "b", "bee"), ("a", "[[P|pea]]", "p", "pea")], "source string, markup string, target string, label string")
    names = spark.createDataFrame([("b", "bee hive"), ("p", "Secret Garden")], "doc string, name string")
    allow = spark.createDataFrame([("a.md", "one"), ("b.md", "two")], "path string, public string")
    assert {r.doc: r.markdown for r in export.export(docs, allow, links, names).collect()} == {"one": "see [[two|bee]] and pea", "two": "text"}
    with pytest.raises(export.Leak):
        export.export(docs, allow.unionAll(spark.createDataFrame([("no.md", "x")], allow.schema)), links, names)
    bad = docs.unionAll(spark.createDataFrame([("q", "q.md", "the secret, garden!")], docs.schema))
    with pytest.raises(export.Leak):
        export.export(bad, allow.unionAll(spark.createDataFrame([("q.md", "x")], allow.schema)), links, names)


def test_packing_stays_in_the_budget(spark):
    e = spark.createDataFrame([("c", i, 1500) for i in range(1, 8)] + [("d", 1, 9)], "center string, rank int, chars int")
    chars = spark.createDataFrame([("c", 100_000)], "center string, chars int")
    got = {(r.center, r.rank): r.taken for r in panels.pack_evidence(e, chars, total=10_000).collect()}
    assert [got["c", i] for i in range(1, 8)] == [1500, 1500, 1000, 0, 0, 0, 0] and got["d", 1] == 9
    with pytest.raises(ValueError):
        panels.page(e, ["rank"], 0, 501)
