"""Connected components: the same as by union-find, and no round for links that are stars already."""

import random

import pytest

from quillgraph.llm import components, shared


def union_find(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for a, b in links if a != b for x in (a, b)}


@pytest.fixture
def writes(monkeypatch):
    seen, real = [], shared.written
    monkeypatch.setattr(shared, "written", lambda rows, name: seen.append(name) or real(rows, name))
    return seen


def found(spark, links, parts=5):
    rows = components.connected_components(spark.createDataFrame(links, "a long, b long").repartition(parts)).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.component for r in rows}


@pytest.mark.parametrize("seed", range(2))
def test_any_links(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7), (-5, -5)]
    assert found(spark, links) == union_find(links)


def test_stars_need_no_round(spark, writes):
    links = [(10 * i, 10 * i + k) for i in range(30) for k in range(1, 9)]
    assert found(spark, links + links[:50]) == union_find(links) and len(writes) == 1
    assert found(spark, [(3, 3)]) == {} and len(writes) == 2


def test_a_task_s_links_leave_it_as_stars(spark, writes):
    links = [(i, i + 1) for i in range(2000)]
    assert found(spark, links, 1) == union_find(links) and len(writes) == 1


def test_few_shuffles_a_round(spark, monkeypatch):
    """With many partitions a round costs what its shuffles cost: one of the links, one of the jumps, and a repeat of the first that is not run again."""
    shuffles, real = [], shared.written
    monkeypatch.setattr(shared, "written", lambda rows, name: shuffles.append(rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")) or real(rows, name))
    links = [(i, i + 1) for i in range(40)]
    assert found(spark, links) == union_find(links) and len(shuffles) > 1 and max(shuffles) <= 3


@pytest.mark.parametrize("parts", (1, 7))
def test_paths_hubs_and_trees(spark, writes, parts):
    rng = random.Random(3)
    name = list(range(6000))
    rng.shuffle(name)
    path = [(name[i], name[i + 1]) for i in range(1500)]
    hub = [(name[2000], name[2000 + i]) for i in range(1, 1500)] + [(name[2000 + i], name[4000 + i]) for i in range(1, 700)]
    tree = [(name[5000 + i], name[5000 + i // 2]) for i in range(1, 900)]
    links = path + hub + tree
    rng.shuffle(links)
    assert found(spark, links, parts) == union_find(links) and len(writes) <= 9
