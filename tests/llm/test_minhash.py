import random
import re

import pytest

from quillgraph.llm import op3_minhash as op3
from quillgraph.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=2):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows):
    ids = sorted({i for i, t in rows if i is not None and shingles(t)})
    sets = {}
    for i, t in rows:
        if i is not None and shingles(t):
            sets.setdefault(i, set()).add(shingles(t))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    out = []
    for i, t in rows:
        s = shingles(t)
        c = find(i) if i is not None and s else i
        out.append((i is not None, i or 0, len(s), c if c is not None else -1, i == c))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, bases = [], [words(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 25, 33, 60, 120, 300])) for _ in range(60)]
    for i in range(330):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 3, max(1, len(w) // 15)])):
            k = rng.randrange(len(w) + 1)
            if rng.random() < 0.5:
                w[k : k + 1] = [rng.choice(vocab)]
            else:
                w[k:k] = [rng.choice(vocab)]
        rows.append((i, rng.choice([" ", "\n"]).join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, rows[0][1]), (3, rows[3][1]), (5, rows[9][1]), (1003, "A b C"), (1004, "a B c"), (1005, " ".join(f"x{i}" for i in range(3000))), (1006, " ".join(f"x{i}" for i in range(2700)))]
    return rows


@pytest.mark.parametrize(("seed", "long", "block", "hubs", "group", "bits"), [(1, 50, 256, 8, 64, 64), (2, 4, 8, 1, 3, 64), (3, 6, 8, 2, 64, 8)])
def test_against_brute_force(spark, monkeypatch, seed, long, block, hubs, group, bits):
    """Also with small blocks and groups, and with hashes of 8 bits, which all collide."""
    for name, value in (("LONG", long), ("BLOCK", block), ("HUBS", hubs), ("GROUP", group)):
        monkeypatch.setattr(op3, name, value)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, component string").repartition(3)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id, r.kept) for r in op3.near_duplicates(df, bits=bits).collect())
    assert got == brute(rows)


def test_empty(spark):
    assert op3.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_path_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (901, 901)], "a long, b long").repartition(4)
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 900: 900, 901: 900}
