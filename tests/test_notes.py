"""Parsing, chunks, sources, search, ingest, streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.policy import Chunking, EmbeddingSpace
from quillgraph.functions.text import normal_path, utf16_length
from quillgraph.operators import ingest, search
from quillgraph.operators.chunks import cut_section, knowledge_units
from quillgraph.operators.parse import assign_sections, child, own_texts, parse, parse_notes
from quillgraph.sources import vault
from quillgraph.streaming import ingest as stream_ingest
from quillgraph.streaming import sessions


def test_exclusions_and_offsets():
    text = '---\ntitle: T\naliases: [X, 3]\n---\n# Head\n\nBeta `Beta` [Beta](u) ![[Beta.png|100]] <b>x</b> https://Beta.io [[Beta|b]] \\[[Beta]]\n\n```\nBeta\n```\n\n    Beta\n\n![alt](p.png) ![r][ref]\n\n[ref]: q.png\n'
    p = parse("d", "dir/Stem.md", text)
    assert p.title == "T" and p.names == [("Stem", "filename"), ("T", "frontmatter"), ("X", "alias"), ("Head", "heading")] and p.warnings
    assert all(text[s["start"] : s["end"]] == s["text"] for s in p.spans)
    assert sum("Beta" in s["text"] for s in p.spans) == 2  # the first word, and the escaped link
    assert [(x["target"], x["label"]) for x in p.links] == [("Beta", "b")]
    assert [(x["source"], x["alt"]) for x in p.media] == [("Beta.png", ""), ("p.png", "alt"), ("q.png", "r")]


def test_bom_crlf_and_sections():
    text = "\ufeff# A\r\n\r\none\r\n\r\n## B\r\ntwo\r\n# C\r\nSetext\r\n---\r\n## B\r\n"
    p = parse("d", "a.md", text)
    assert [(s["title"], s["depth"]) for s in p.sections] == [("", 0), ("A", 1), ("B", 2), ("C", 1), ("Setext", 2), ("B", 2)]
    a, b = p.sections[1], p.sections[2]
    assert text[a["start"] : a["end"]].startswith("# A") and a["end"] == p.sections[3]["start"] == b["end"]
    assert p.sections[2]["section"].endswith('["A","B"]:0') and p.sections[5]["section"].endswith('["C","B"]:0')


def test_as_of_sections_and_units(spark):
    n = spark.createDataFrame([("d", "d.md", "intro\n\n# A\n\n" + "One two. " * 30 + "\n\n# B\n\nshort\n"), ("bad", "b.md", "---\na: [\n---\n")], "doc string, path string, markdown string")
    parsed = parse_notes(n)
    assert [r.doc for r in parsed.where("error is not null").collect()] == ["bad"]
    s = child(parsed, "sections")
    at = spark.createDataFrame([("d", 0), ("d", 8), ("d", 400)], "doc string, at long")
    assert [r.section.split(":", 1)[1] for r in assign_sections(at, s).orderBy("at").collect()] == ["root", 'section:["A"]:0', 'section:["B"]:0']
    own = own_texts(n, s).withColumn("path", F.col("path"))
    units = knowledge_units(own, Chunking(max_tokens=100)).orderBy("start").collect()
    assert all(u.tokens <= 100 and u.error is None for u in units) and len(units) > 4
    assert knowledge_units(own, Chunking(max_tokens=3)).where("error is not null").count() > 0
    assert cut_section("aaa. bbb. ccc", "", 10, len) == [(0, 10), (10, 13)]


def test_paths_and_utf16(spark):
    rows = [("a/./b/../c.md", "a/c.md"), ("/a", None), ("C:\\a", None), ("..", None), ("a\\b.md", "a/b.md"), ("", None), ("a/../../b", None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "p string")
    assert {r.p: r.n for r in df.select("p", normal_path(F.col("p")).alias("n")).collect()} == dict(rows)
    assert spark.createDataFrame([("😀A",)], "t string").select(utf16_length(F.col("t"))).first()[0] == 3


def test_vault_scan_rules_and_scope(spark, tmp_path):
    for path, text in {"drafts/a.md": "a", "drafts/keep.md": "k\r\n", "Wiki/a.md": "w", "Wiki/sub/b c.md": "é", ".x/h.md": "h", "AGENTS.md": "n", "p.png": "png"}.items():
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_bytes(text.encode())
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    rules = "drafts/*\n!drafts/keep.md\n"
    assert sorted((r.path, r.markdown) for r in vault.scan(spark, str(tmp_path), rules).collect()) == [("Wiki/a.md", "w"), ("Wiki/sub/b c.md", "é"), ("drafts/keep.md", "k\r\n")]
    paths = spark.createDataFrame([("drafts/a.md",), ("drafts/keep.md",), ("Wiki/a.md",), ("Wiki/sub/b.md",)], "path string")
    assert {r.folder: (r.included, r.excluded) for r in vault.scope(paths, rules).collect()} == {"drafts": (1, 1), "Wiki": (2, 0), "Wiki/sub": (1, 0)}
    ref = spark.createDataFrame([("d", "drafts/", "p.png"), ("d", "", "none.png")], "doc string, folder string, source string")
    assert [r.source for r in vault.media(spark, str(tmp_path), ref).collect()] == ["p.png"]


def test_search_modes(spark):
    d = spark.createDataFrame([("a", "JS", "Array.from() and C++ with Qwen3.5-2B, 词法 作用域"), ("b", "AI", "Array.fromAsync() or Qwen3.5-2B-Instruct")], "doc string, title string, body string")
    docs = lambda x: [r.doc for r in x.collect()]
    assert docs(search.search_text(d, "词法")) == ["a"]
    assert docs(search.search_exact(d, "Qwen3.5-2B")) == ["a"] and docs(search.search_literal(d, "Qwen3.5-2B")) == ["a", "b"]
    assert docs(search.search_literal(d, "++")) == ["a"] and docs(search.search_browser(d, "QWEN")) == ["a", "b"]
    with pytest.raises(ValueError):
        search.search_text(d, " ")


def test_store_commits_and_conflicts(spark, tmp_path):
    store = ingest.Store(spark, str(tmp_path / "store"))
    one = spark.createDataFrame([(1,)], "x int")
    assert store.generation() == 0 and store.commit({"t": one, "u": one}, 0) == 1
    assert store.commit({"t": one.unionAll(one)}, 1) == 2
    assert store.read("t").count() == 2 and store.read("u").count() == 1
    with pytest.raises(ingest.Conflict):
        store.commit({"t": one}, 1)


def test_streamed_versions(spark, tmp_path):
    schema = "doc string, path string, markdown string, deleted boolean, sequence long"
    src = tmp_path / "in"
    store = ingest.Store(spark, str(tmp_path / "store"))

    def put(name, rows):
        os.makedirs(src, exist_ok=True)
        (src / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("doc", "path", "markdown", "deleted", "sequence"), r))) for r in rows))
        stream_ingest.start(spark.readStream.schema(schema).json(str(src)), store, str(tmp_path / "check")).awaitTermination()
        return {r.doc: (r.revision, r.epoch, r.markdown, r.deleted) for r in store.read("documents").collect()}

    assert put("1", [("a", "a.md", "x", False, 1), ("b", "b.md", "y", False, 2), ("b", "b.md", "z", False, 3)]) == {"a": (1, 1, "x", False), "b": (1, 1, "z", False)}
    assert put("2", [("a", "a.md", "x", False, 4), ("b", "b.md", None, True, 5)]) == {"a": (1, 1, "x", False), "b": (1, 2, "z", True)}
    assert put("3", [("b", "b.md", "z", False, 6)]) == {"a": (1, 1, "x", False), "b": (2, 3, "z", False)}


def test_session_machine_and_stream(spark, tmp_path):
    s = sessions.Session()
    s.apply("focus", "a"), s.apply("lens", 80), s.apply("focus", "b"), s.apply("more", None)
    assert s.state["current"]["budget"] == 80 and len(s.state["back"]) == 1
    s.apply("back", None)
    assert s.state["current"] == {"focus": "a", "lens": 80.0, "budget": 40, "revision": 1}
    assert sessions.Session.restore(s.export()).state == s.state
    with pytest.raises(ValueError):
        sessions.Session.restore('{"schemaVersion": 9}')
    events = spark.createDataFrame([(1, 1, 0, "view", 1.0), (2, 1, 60, "click", 80.0), (3, 2, 0, "view", 1.0), (4, 1, 4000, "view", 1.0)], "event_id long, user_id long, t long, event_type string, value double").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    want = sorted(map(tuple, sessions.replay(events).collect()))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    q = sessions.stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("sess").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("sess").collect())) == want
    assert sessions.idle_windows(events).count() == 3


def test_space_ids():
    a = EmbeddingSpace("m", "1", 3, True)
    assert a.id == EmbeddingSpace("m", "1", 3, True).id != EmbeddingSpace("m", "1", 3, True, chunking=Chunking(max_tokens=9)).id
