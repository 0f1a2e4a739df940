"""Scores, cuts, thresholds and matches at exact numbers."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.policy import BoundaryPolicy, Retrieval, ScorePolicy, changed_policy
from quillgraph.operators import boundary, entities, explore, mentions, relations, vectors
from quillgraph.operators.parse import child, parse_notes

EVIDENCE = "kind string, source string, section string, status string, target string"


def mention(a, b, *sections):
    return [("mention", a, s, "resolved", b) for s in sections]


@pytest.mark.parametrize(
    ("evidence", "score"),
    [
        (mention("a", "b", "1"), 0.5),
        (mention("a", "b", *["1"] * 100), 0.5),
        (mention("a", "b", "1", "2", "3"), 0.7),
        (mention("a", "b", *map(str, range(21))), 0.8),
        (mention("a", "b", "1") + mention("b", "a", "1"), 0.6),
        ([("explicit", "a", "1", "resolved", "b")], 0.3),
        ([("explicit", "a", "1", "resolved", "b"), *mention("a", "b", "1")], 0.65),
    ],
)
def test_scores(spark, evidence, score):
    noise = [("mention", "a", "1", "ambiguous", None), ("mention", "a", "1", "resolved", "a")]
    rows = relations.score(relations.candidates(spark.createDataFrame(evidence + noise, EVIDENCE))).collect()
    assert [(r.node_a, r.node_b, r.score) for r in rows] == [("a", "b", score)]


def pool_of(spark, scores):
    return spark.createDataFrame([("c", f"n{i:03d}", s, i + 1) for i, s in enumerate(scores)], "center string, neighbor string, similarity double, rank int")


@pytest.mark.parametrize(
    ("scores", "cut"),
    [
        ([0.94, 0.92, 0.90, 0.88, 0.86, 0.84, 0.82, 0.64, 0.63, 0.62], 7),
        ([0.48, 0.47, 0.46, 0.39, 0.38, 0.37], 3),
        ([0.97 - 0.008 * i for i in range(25)] + [0.60, 0.59, 0.58], 25),
        ([0.90, 0.89, 0.875, 0.86, 0.845, 0.83], None),
        ([0.99, 0.80, 0.79, 0.78, 0.77, 0.76], None),
        ([0.99, 0.80, 0.79, 0.78, 0.60, 0.59, 0.58], 4),
        ([0.9, 0.1, 0.05], None),
        ([0.9], None),
    ],
)
def test_cut_ranks(spark, scores, cut):
    assert boundary.diagnostics(pool_of(spark, scores)).first().cut_rank == cut


def test_the_floor_comes_after_the_gap(spark):
    rows = boundary.decisions(pool_of(spark, [0.48, 0.47, 0.46, 0.39, 0.38, 0.37])).collect()
    assert {r.reason for r in rows} == {"quality-floor"} and not any(r.accepted for r in rows)


def centered(spark, scores):
    rows = [("c", f"n{i:02d}", s, s == 0.9, s == 0.05, "c", f"n{i:02d}") for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "center string, neighbor string, score double, hidden boolean, pinned boolean, node_a string, node_b string")


def test_visibility_grows_with_the_lens_and_adds_up(spark):
    c = centered(spark, [0.9, 0.7, 0.6, 0.6, 0.5, 0.4, 0.3, 0.05]).cache()
    before = set()
    for lens in (0, 20, 40, 60, 80, 100):
        now = {r.neighbor for r in explore.visible(c, lens).collect()}
        assert before <= now and "n00" not in now and "n07" in now
        before = now
        n = explore.counters(c, lens, 2).first()
        assert n.eligible == n.visible + n.remaining and n.pinned == 1
    assert len(before) == 7


def test_threshold_at_seventy(spark):
    c = centered(spark, [0.7, 0.6, 0.5, 0.3])
    m = explore.lens_mapping(c).withColumn("t", explore.threshold(F.lit(70), F.col("low"), F.col("high"))).first()
    assert (m.low, m.high, m.t) == (0.3, 0.7, 0.42)
    assert explore.visible(c, 70).count() == 3


def test_cross_relations_need_both_ends(spark):
    one = lambda a, b, s: ("x", *sorted((a, b)), s)
    rows = [(a, b, *one(a, b, s)[1:], False, False) for a, b, s in [("a", "b", 0.5), ("b", "a", 0.5), ("a", "c", 0.5), ("c", "a", 0.5), ("a", "d", 0.4), ("d", "a", 0.4), ("b", "c", 0.6), ("c", "b", 0.3), ("b", "d", 0.9)]]
    df = spark.createDataFrame(rows, "center string, neighbor string, node_a string, node_b string, score double, hidden boolean, pinned boolean")
    got = explore.cross_relations(df, spark.createDataFrame([("a",)], "doc string")).collect()
    assert [(r.focus, r.node_a, r.node_b, r.score) for r in got] == [("a", "b", "c", 0.3)]


def test_policies():
    with pytest.raises(ValueError):
        ScorePolicy(mention_base=0.9)
    with pytest.raises(ValueError):
        changed_policy(ScorePolicy(), ScorePolicy(mention_cap=0.9))
    with pytest.raises(ValueError):
        BoundaryPolicy(quality_floor=2)


def test_pool_by_best_unit_and_by_top_mean(spark):
    rows = [("u1", "a", "1", [1.0, 0.0]), ("u2", "a", "2", [0.0, 1.0]), ("u3", "b", "1", [1.0, 0.0]), ("u4", "b", "1", [0.8, 0.6]), ("u5", "c", "1", [0.6, 0.8])]
    u = spark.createDataFrame(rows, "unit string, doc string, section string, vector array<double>")
    for block in (2048, 1):
        best = {(r.center, r.neighbor): (round(r.similarity, 9), r.rank, r.pool_size) for r in vectors.semantic_pool(u, Retrieval(budget=1), block).collect()}
        assert best == {("a", "b"): (1.0, 1, 2), ("b", "a"): (1.0, 1, 2), ("c", "b"): (0.96, 1, 2)}
    mean = {(r.center, r.neighbor): round(r.similarity, 9) for r in vectors.semantic_pool(u, Retrieval(aggregation="top-mean")).collect()}
    assert mean["a", "b"] == 1.0 and mean["a", "c"] == 0.8


def test_matcher_boundaries_and_longest_match():
    m = mentions.Matcher(["CSRF", "SSRF", "事件循环", "事件"])
    assert [(a, t) for a, _, t in m.matches("😀 CSRF 有别于 SSRF。SSRF 不是 SSRFProxy。")] == [(2, "CSRF"), (11, "SSRF"), (16, "SSRF")]
    assert [t for _, _, t in m.matches("事件循环和事件")] == ["事件循环", "事件"]


def test_notes_end_to_end(spark):
    notes = [
        ("p", "Promise.md", "# Promise\n\nMicrotask one.\n\n## 调度\n\nMicrotask, Event Loop.\n\n## 后续\n\nMicrotask and Event Loop. [[Async-Await|异步]] `Web Workers`\n"),
        ("m", "Microtask.md", "---\naliases: [微任务]\n---\n# Microtask\n"),
        ("e", "Event Loop.md", "# Event Loop\n"),
        ("w", "Web Workers.md", "# Web Workers\n\nA Promise.\n"),
        ("a", "Async-Await.md", "# Async-Await\n"),
        ("c1", "a/Cache.md", "# Cache\n"),
        ("c2", "b/Cache.md", "# Cache\n\n[[a/Cache]] [[Cache]] [[./Cache.md#Cache]] [[#cache]] [[../x]]\n"),
    ]
    n = spark.createDataFrame(notes, "doc string, path string, markdown string")
    parsed = parse_notes(n).cache()
    assert parsed.where("error is not null").count() == 0
    names = entities.dictionary(child(parsed, "names"))
    sections = child(parsed, "sections")
    m = mentions.dictionary_mentions(child(parsed, "spans"), names)
    links = entities.resolve_links(child(parsed, "links").select(F.col("doc").alias("source"), F.col("target").alias("raw")), names, n.select("doc", "path"), sections)
    assert {r.raw: (r.status, r.target) for r in links.where("source = 'c2'").collect()} == {"a/Cache": ("resolved", "c1"), "Cache": ("ambiguous", None), "./Cache.md#Cache": ("resolved", "c2"), "#cache": ("resolved", "c2"), "../x": ("missing", None)}
    evidence = m.select(F.lit("mention").alias("kind"), F.col("doc").alias("source"), "section", "status", "target").unionByName(links.select(F.lit("explicit").alias("kind"), "source", F.lit("l").alias("section"), "status", "target"))
    scores = {(r.node_a, r.node_b): r.score for r in relations.score(relations.candidates(evidence)).collect()}
    assert scores == {("m", "p"): 0.7, ("e", "p"): 0.6, ("p", "w"): 0.5, ("a", "p"): 0.3, ("c1", "c2"): 0.3}
