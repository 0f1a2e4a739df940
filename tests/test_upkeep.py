"""Upkeep of derived data and the lookups of the surfaces."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.text import fold_marks, name_key
from quillgraph.operators import entities, evaluation, ingest, mentions, search, upkeep
from quillgraph.sources import vault


def test_ignore_rules_keep_parents_closed(spark):
    def out(rules, *paths, folder=False):
        d = spark.createDataFrame([(p,) for p in paths], "path string")
        return {r.path for r in d.where(~vault.kept_by(F.col("path"), rules, folder)).collect()}

    rules = "# comment\n/Archive/\n**/drafts/\n*.tmp.md\nnotes/*\n!notes/keep.md"
    gone = {"Archive/a.md", "Archive/nested/b.md", "drafts/a.md", "nested/drafts/a.md", "a.tmp.md", "nested/a.tmp.md", "notes/drop.md"}
    assert out(rules, *gone, "nested/Archive/a.md", "notes/keep.md", "source.md") == gone
    assert out("private/\n!private/keep.md", "private/keep.md") == {"private/keep.md"}
    assert out("private/*\n!private/keep.md", "private/keep.md") == set()
    assert out(rules, "Archive", folder=True) == {"Archive"} and out(rules, "Archive") == set()
    assert out("x[ab].md\ny[!a].md\n\\#z.md\na/**/b.md\nc/**", "xa.md", "xc.md", "ya.md", "yb.md", "#z.md", "a/b.md", "a/q/r/b.md", "c/d/e.md", "c") == {"xa.md", "yb.md", "#z.md", "a/b.md", "a/q/r/b.md", "c/d/e.md"}
    d = spark.createDataFrame([("../a.md",), ("/a.md",), ("a//b.md",), ("",), (None,), ("./a.md",)], "path string")
    assert [r[0] for r in d.select(vault.kept_by(F.col("path"), "b.md")).collect()] == [None, None, None, None, None, True]
    with pytest.raises(ValueError):
        vault.compile_rules("x\0y")


def test_listing_and_bounded_scan(spark, tmp_path):
    for name, text in (("b.md", "# B"), ("a+1.md", "a"), ("sub/c.markdown", "c"), ("AGENTS.md", "x"), (".hid/d.md", "d"), ("e.txt", "e")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    assert [r.path for r in vault.list_paths(spark, str(tmp_path)).collect()] == ["a+1.md", "b.md", "bad.md"]
    assert {r.path for r in vault.scan_directory(spark, str(tmp_path), "b.md").collect()} == {"a+1.md", "sub/c.markdown", "AGENTS.md"}
    for limits in ((2, 99, 99), (99, 2, 99), (99, 99, 5)):
        with pytest.raises(ValueError):
            vault.scan_directory(spark, str(tmp_path), "", limits)


def test_names_in_any_form_are_one(spark):
    words = ["Café", "ÅNGSTRÖM", "tiếng Việt", "naïve", "plain", "ñandú", "Ελληνικά", "日本", "ệ", "", "́x"]
    rows = [(i, unicodedata.normalize("NFD", w), w) for i, w in enumerate(words)]
    d = spark.createDataFrame(rows, "i int, nfd string, w string")
    for r in d.select("nfd", name_key(F.col("nfd")).alias("k"), name_key(F.col("w")).alias("v"), fold_marks(F.col("w")).alias("f")).collect():
        assert r.k == unicodedata.normalize("NFC", r.nfd).strip().lower() == r.v
        assert r.f == "".join(c for c in unicodedata.normalize("NFD", r.v) if not unicodedata.combining(c))
    docs = spark.createDataFrame([("a", "un café noir", "x"), ("b", "le cafe", "x"), ("c", "thé", "x")], "doc string, body string, title string")
    assert {r.doc for r in search.search_text(docs, "CAFÉ").collect()} == {"a", "b"}


def test_resolutions_count_places(spark):
    e = spark.createDataFrame([("ada", "d1", None, "title", False), ("ada", "d1", None, "alias", False), ("bob", "d1", None, "t", False), ("bob", "d2", None, "t", False), ("cy", "d3", "s1", "user", False), ("cy", "d3", "s2", "user", False), ("x", "d4", None, "t", False)], "name_key string, doc string, section string, source string, allow_short boolean")
    got = {r.name_key: (r.status, r.candidates, r.target) for r in entities.resolutions(e).collect()}
    assert got == {"ada": ("resolved", 1, "d1"), "bob": ("ambiguous", 2, None), "cy": ("ambiguous", 2, None), "x": ("suppressed", 1, None)}


def test_matcher_against_brute_force():
    rng = random.Random(2)
    names = ["ab", "abc", "a b", "bc", "知识", "知识图", "图谱", "b c a", "c知", "İ", "ß"]
    m = mentions.Matcher(names)

    def brute(text):
        folded = "".join(f if len(f := mentions.fold(c)) == 1 else c for c in text)
        bound = lambda c, i: mentions._latin(c) and 0 <= i < len(folded) and mentions._latin(folded[i])
        out, at = [], 0
        while at < len(folded):
            fits = [n for n in ("".join(map(mentions.fold, n)) for n in names) if folded.startswith(n, at) and not bound(n[0], at - 1) and not bound(n[-1], at + len(n))]
            if fits:
                to = at + max(map(len, fits))
                out.append((at, to, text[at:to]))
                at = to
            else:
                at += 1
        return out

    for _ in range(3000):
        text = "".join(rng.choice(["a", "b", "c", "A", "B", " ", "知", "识", "图", "谱", "_", "ß", "İ"]) for _ in range(rng.randint(0, 14)))
        assert m.matches(text) == brute(text), text
    assert mentions.Matcher([]).matches("abc") == []


def test_nearest_rank_against_sorting(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([rng.random(), 0.5, None, float(rng.randint(0, 3))])) for g in ("a", "a", "a", "b", None) for _ in range(700)] + [("one", 4.0), ("none", None)]
    got = {r.g: (r.p50, r.p95, r.max) for r in evaluation.nearest_rank(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v", parts=7).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        v = sorted((x for h, x in rows if h == g), key=lambda x: (x is not None, x or 0))
        at = lambda s: v[max(1, -(-len(v) * round(100 * s) // 100)) - 1]
        want[g] = (at(0.5), at(0.95), v[-1])
    assert got == want


def test_two_writers_and_old_pointers(spark, tmp_path):
    store, other = ingest.Store(spark, str(tmp_path)), ingest.Store(spark, str(tmp_path))
    one = spark.range(1)
    assert store.commit({"t": one}, 0) == 1
    with pytest.raises(ingest.Conflict):
        other.commit({"t": one}, 0)
    other._pointer, real = lambda: {"generation": 0, "tables": {}}, other._pointer  # it read before the first commit was published
    with pytest.raises(ingest.Conflict):
        other.commit({"t": spark.range(9)}, 0)
    other._pointer = real
    assert other.generation() == 1 and other.read("t").count() == 1
    assert other.commit({"u": spark.range(2)}, 1) == 2 and store.tables() == ["t", "u"]
    memory = upkeep.MemoryStore()
    assert memory.commit({"t": one}, 0) == 1 and memory.tables() == ["t"] and memory.read("t").count() == 1
    with pytest.raises(ingest.Conflict):
        memory.commit({}, 0)


def test_rebuild_and_purge(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "doc string, revision long")
    cached = spark.createDataFrame([("a", 1), ("b", 1), ("z", 1)], "doc string, revision long")
    redone = upkeep.rebuild_scope(docs, cached, True)
    assert {r.doc for r in redone.collect()} == {"b", "c"} and upkeep.rebuild_scope(docs, cached, False).count() == 3
    refs = spark.createDataFrame([("a", "x"), ("b", "x"), ("z", "x")], "source string, target string")
    assert [r.source for r in upkeep.reused_references(refs, docs, redone).collect()] == ["a"]
    names = spark.createDataFrame([("a", "A"), ("b", "B")], "doc string, name string")
    sections = spark.createDataFrame([("a", "root", None, 0)], "doc string, section string, title string, depth int")
    aliases = spark.createDataFrame([], "name string, doc string, section string, allow_short boolean")
    sign = upkeep.entity_signature(names, sections, aliases)
    assert sign == upkeep.entity_signature(names.orderBy(F.desc("doc")), sections, aliases)
    assert sign != upkeep.entity_signature(names.limit(1), sections, aliases)
    states = spark.createDataFrame([("s", "a", 1, "ready"), ("t", "b", 1, "ready"), ("t", "z", 1, "ready")], "space string, doc string, revision long, status string")
    assert sorted(tuple(r) for r in upkeep.invalidate_vectors(states, docs).collect()) == [("s", "a", 1, "ready"), ("t", "b", 1, "pending")]
    records = spark.createDataFrame([("s", "a", [1.0, 0.0]), ("s", "a", [1.0]), ("s", "b", [float("nan"), 1.0]), ("t", "z", [0.0, 1.0])], "space string, doc string, vector array<double>")
    assert {r.doc for r in upkeep.purge_vectors(records, docs).collect()} == {"a", "b"}
    kept, after = upkeep.drop_bad_vectors(records, spark.createDataFrame([("s", "a", "ready", 2), ("s", "b", "ready", 1), ("t", "z", "ready", 1)], "space string, doc string, status string, ready int"), 2)
    assert kept.count() == 2
    assert sorted(tuple(r) for r in after.collect()) == [("s", "a", "pending", 1), ("s", "b", "pending", 0), ("t", "z", "ready", 1)]
    live = spark.createDataFrame([("a", "private/a.md"), ("b", "b.md")], "doc string, path string")
    old = spark.createDataFrame([("c", "c.md"), ("b", "old.md")], "doc string, path string")
    inside, archived = upkeep.change_scope(live, old, vault.kept_by(F.col("path"), "private/"))
    assert sorted(r.path for r in inside.collect()) == ["b.md", "c.md"] and [r.path for r in archived.collect()] == ["private/a.md"]


def test_lookups(spark, tmp_path):
    docs = spark.createDataFrame([("a", 1, "# T\nsome text here"), ("b", 2, "other")], "doc string, revision long, markdown string")
    sections = spark.createDataFrame([("a", "root", 0, 18, 0), ("a", "s1", 0, 18, 1), ("b", "root", 0, 5, 0)], "doc string, section string, s long, e long, depth int")
    loc = spark.createDataFrame([("r1", "mention", "a", 1, "s1", 4, 8), ("r1", "explicit", "a", 1, "s1", 4, 8), ("r2", "mention", "b", 1, "root", 0, 5)], "relation string, kind string, doc string, revision long, section string, start long, end long")
    assert {(r.doc, r.start, r.section) for r in upkeep.deepest_sections(loc.withColumn("end", F.col("end") + F.when(F.col("doc") == "b", 50).otherwise(0)), sections).collect()} == {("a", 4, "s1"), ("b", 0, None)}
    assert upkeep.distinct_locators(loc).count() == 2
    assert upkeep.allowed(loc, docs.where("doc = 'a'")).count() == 2 and upkeep.allowed(loc, docs, loc.where("doc = 'b'")).count() == 1
    report = {(r.relation, r.kind): (r.status, r.text) for r in upkeep.evidence_report(loc, docs, sections).collect()}
    assert report == {("r1", "mention"): ("valid", "some"), ("r1", "explicit"): ("valid", "some"), ("r2", "mention"): ("stale", None)}
    hits = docs.select("doc", "revision")
    assert upkeep.live_hits(hits, docs).count() == 2
    with pytest.raises(upkeep.StaleIndex):
        upkeep.live_hits(hits.withColumn("revision", F.lit(9)), docs)
    names = entities.dictionary(spark.createDataFrame([("a", "Title One", "title"), ("a", "twin", "alias"), ("b", "Twin", "alias")], "doc string, name string, source string"))
    typed = spark.createDataFrame([("'Title One'",), ('"b"',), ("twin",), ("nobody",)], "input string")
    assert {r.input: (r.status, r.doc) for r in upkeep.resolve_inputs(typed, docs, names).collect()} == {"'Title One'": ("resolved", "a"), '"b"': ("resolved", "b"), "twin": ("ambiguous", None), "nobody": ("missing", None)}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "node_a string, node_b string")
    assert [r.muted for r in upkeep.hover(edges, "b").orderBy("node_a").collect()] == [False, False, True]
    assert {r.node for r in upkeep.hover_nodes(edges, "b").collect()} == {"a", "b", "c"} and [r.node for r in upkeep.hover_nodes(edges, "q").collect()] == ["q"]
    cover = upkeep.frozen_coverage(spark.createDataFrame([(True, "u1"), (True, "u1"), (False, "u2"), (False, "u1")], "valid boolean, unit string")).first()
    assert tuple(cover) == ("ready", 1, 2)
    (tmp_path / "x.db").write_text("x")
    (tmp_path / "app.js").write_text("see /home/someone/notes")
    (tmp_path / "ok.json").write_text("secret plan")
    assert sorted((r.path.rsplit("/", 1)[1], r.fault) for r in upkeep.artifact_faults(spark, str(tmp_path), ("secret plan",)).collect()) == [("app.js", "local path or key"), ("ok.json", "forbidden text 0"), ("x.db", "private file")]


def test_a_memory_store_keeps_what_was_committed(spark, tmp_path):
    place = str(tmp_path / "t")
    spark.range(3).write.parquet(place)
    memory = upkeep.MemoryStore()
    memory.commit({"t": spark.read.parquet(place)}, 0)
    spark.range(9).write.mode("overwrite").parquet(place)
    assert memory.read("t").count() == 3 and memory.generation() == 1
