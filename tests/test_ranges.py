"""Ranks by ranges, triangles of hubs, and sections of spans, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import explore, panels, relations, upkeep


@pytest.mark.parametrize("sampled", [(4, 2), (128, 16)])
def test_label_rank_with_equal_degrees(spark, monkeypatch, sampled):
    monkeypatch.setattr(relations, "RANGES", sampled[0])
    monkeypatch.setattr(relations, "SAMPLED", sampled[1])
    rng = random.Random(4)
    for n, fraction in ((0, 0.3), (1, 0.3), (200, 0.3), (200, 1.0), (57, 0.01)):
        rows = [(f"d{i:04d}", rng.choice([0, 0, 0, 1, 1, 5, 9])) for i in range(n)]
        got = sorted((r.label_rank, r.doc, r.degree) for r in relations.label_rank(spark.createDataFrame(rows, "doc string, degree long").repartition(3), fraction).collect())
        order = sorted(rows, key=lambda r: (-r[1], r[0]))[: max(3, math.ceil(round(n * fraction, 9)))]
        assert got == [(k + 1, *r) for k, r in enumerate(order)]


def test_cross_relations_around_a_hub(spark):
    rng = random.Random(9)
    names = [f"n{i:02d}" for i in range(30)]
    pairs = {(a, b) for a in names for b in names if a < b and (a == "n00" or rng.random() < 0.15)}
    rows = []
    for a, b in pairs:
        hidden, score = rng.random() < 0.1, rng.random()
        rows += [(a, b, a, b, score, hidden)] + ([(b, a, a, b, score / 2, hidden)] if rng.random() < 0.9 else [])
    centered = spark.createDataFrame(rows, "center string, neighbor string, node_a string, node_b string, score double, hidden boolean")
    focuses = names[:12]
    got = sorted(tuple(r) for r in explore.cross_relations(centered, spark.createDataFrame([(f,) for f in focuses], "doc string")).collect())
    shown = [r for r in rows if not r[5]]
    near = {f: {r[1] for r in shown if r[0] == f} for f in focuses}
    ends = {}
    for r in shown:
        ends.setdefault((r[2], r[3]), []).append((r[0], r[4]))
    both = {p: min(s for _, s in e) for p, e in ends.items() if len({c for c, _ in e}) == 2}
    assert got == sorted((f, a, b, s) for f in focuses for (a, b), s in both.items() if a in near[f] and b in near[f])


def test_deepest_sections_of_any_spans(spark):
    rng = random.Random(2)
    sections, locators = [], []

    def nest(doc, s, e, depth):
        sections.append((doc, f"{doc}:{s}:{e}:{depth}", s, e, depth))
        at = s
        while depth < 4 and at < e and rng.random() < 0.7:
            a = rng.randint(at, e)
            z = rng.randint(a, e)
            nest(doc, a, z, depth + 1)
            at = z
    for d in range(6):
        nest(f"d{d}", 0, 60, 0)
    for i in range(300):
        a = rng.randint(0, 70)
        locators.append((i, f"d{rng.randint(0, 7)}", a, a + rng.randint(0, 30), [1.5, None], "old"))
    rows = spark.createDataFrame(locators, "n long, doc string, start long, end long, more array<double>, section string").repartition(3)
    got = {r.n: r for r in upkeep.deepest_sections(rows, spark.createDataFrame(sections, "doc string, section string, s long, e long, depth int").repartition(2)).collect()}
    assert len(got) == 300
    for n, doc, a, z, more, _ in locators:
        best = max(((k, s, name) for d, name, s, e, k in sections if d == doc and s <= a and e >= z), default=(0, 0, None))[2]
        assert got[n].section == best and got[n].more == more, (n, doc, a, z)


@pytest.mark.parametrize("sampled", [(4, 2), (64, 16)])
def test_tree_order_with_numbers_and_scripts(spark, monkeypatch, sampled):
    """Against one sort of all siblings by the collation; and the cases that plain order gets wrong."""
    monkeypatch.setattr(panels, "RANGES", sampled[0])
    monkeypatch.setattr(panels, "SAMPLED", sampled[1])
    names = ["a2.md", "a10.md", "a010.md", "a9b3.md", "a9b20.md", "b.md", "中.md", "啊.md", "á.md", "z" + "9" * 50 + ".md", "z1.md", "2.md", "10.md"] + [f"flat/{i}.md" for i in range(150)] + ["a1/x.md", "a/2/c.md", "a/10/c.md", "a/x.md"]
    tree = panels.path_tree(spark.createDataFrame([(x,) for x in names], "path string").repartition(3))
    got = panels.tree_order(tree).collect()
    assert len(got) == tree.count()
    for parent in {r.parent for r in got}:
        own = sorted((r for r in got if r.parent == parent), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, len(own) + 1)) and {r.siblings for r in own} == {len(own)}
        assert [r.folder for r in own] == sorted((r.folder for r in own), reverse=True)
        one = tree.where(F.col("parent") == parent).orderBy(F.desc("folder"), panels.natural_key(F.substring_index("path", "/", -1)), "path").collect()
        assert [r.path for r in own] == [r.path for r in one]
    top = [r.path for r in sorted(got, key=lambda r: r.place) if r.parent == ""]
    at = top.index
    assert at("a2.md") < at("a9b3.md") < at("a9b20.md") < at("a10.md") < at("b.md") and at("2.md") < at("10.md") and at("啊.md") < at("中.md")
    assert [r.path for r in sorted(got, key=lambda r: r.place) if r.parent == "flat"] == [f"flat/{i}.md" for i in range(150)]
