"""Name matching and stated cosines against brute force."""

import random

import numpy as np
import pytest
import regex

from quillgraph.functions.hashes import bit_set, may_hold
from quillgraph.operators.mentions import Matcher, fold, intervals
from quillgraph.operators.vectors import asked_cosines

LATIN = regex.compile(r"[\p{Script=Latin}\p{N}_]")


def brute(names, text):
    low = "".join(f if len(f := fold(c)) == 1 else c for c in text)
    keys = sorted({"".join(map(fold, n)) for n in names}, key=len, reverse=True)
    out, at = [], 0
    while at < len(low):
        for k in keys:
            to = at + len(k)
            left = LATIN.match(k[0]) and at > 0 and LATIN.match(low[at - 1])
            right = LATIN.match(k[-1]) and to < len(low) and LATIN.match(low[to])
            if low.startswith(k, at) and not left and not right:
                out.append((at, to, text[at:to]))
                at = to
                break
        else:
            at += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_matcher_against_brute_force(seed):
    rng = random.Random(seed)
    letters = "abB 1_-\u4e2d\u6587\u00c9\u00e9\u0416]^\\\u00df"
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    for _ in range(60):
        names = [word(4) for _ in range(rng.randint(1, 12))]
        matcher = Matcher(names)
        for text in ("", word(40), word(40), names[0] * 3):
            assert matcher.matches(text) == brute(names, text), (names, text)


def test_matcher_without_names_finds_nothing():
    assert Matcher([]).matches("any text") == [] and Matcher([""]).matches("any") == []


def test_asked_cosines_in_small_blocks(spark):
    rng = random.Random(3)
    rows = [(f"u{i:02d}", [rng.uniform(-1, 1) for _ in range(3)]) for i in range(23)]
    units = spark.createDataFrame(rows, "unit string, vector array<double>")
    got = {(r.unit_a, r.unit_b): r.cosine for r in asked_cosines(units.where("unit < 'u07'"), units, 4).collect()}
    want = {(a, b): sum(x * y for x, y in zip(v, w, strict=True)) for a, v in rows if a < "u07" for b, w in rows if a != b}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert asked_cosines(units.where("false"), units).isEmpty() and asked_cosines(units, units.where("false")).isEmpty()


@pytest.mark.parametrize("filtered", [True, False])
def test_distributed_matching_against_the_trie(spark, filtered):
    """Any names and texts: joined runs of units and the trie give the same intervals."""
    rng = random.Random(12)
    letters = "abB 1_-中文ÉéЖ]^\\ß\n"
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    names = sorted({word(5) for _ in range(60)})
    texts = [(f"d{i % 3}", str(i % 2), f"b{i}", 10 * i, word(60) + rng.choice(names) * 2) for i in range(120)]
    texts += [("d", "s", "b", 0, None), ("d", "s", "b", 5, ""), ("long", "s", "b", 0, (names[0] + " ") * 5000)]
    spans = spark.createDataFrame(texts, "doc string, section string, block string, start long, text string").repartition(3)
    got = {}
    for r in intervals(spans, spark.createDataFrame([(n,) for n in names], "name_key string"), filtered, 3).collect():
        got.setdefault((r.doc, r.section, r.block), []).append((r.start, r.end, r.name))
    matcher = Matcher(names)
    for doc, section, block, start, text in texts:
        want = [(start + a, start + z, t) for a, z, t in matcher.matches(text or "")]
        own = sorted(got.get((doc, section, block), []))
        assert own == want or (doc, block) == ("d", "b"), (text, own, want)


def test_no_names_find_nothing(spark):
    spans = spark.createDataFrame([("d", "s", "b", 0, "any text")], "doc string, section string, block string, start long, text string")
    names = spark.createDataFrame([], "name_key string")
    assert intervals(spans, names).collect() == [] and intervals(spans.limit(0), spark.createDataFrame([("any",)], "name_key string")).collect() == []


def test_bits_rule_out_and_never_lose(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63, 5000)
    bits = bit_set(spark.createDataFrame([(int(x),) for x in h], "h long"), 17)
    assert may_hold(bits, h.view(np.uint64)).all()
    assert may_hold(bits, rng.integers(0, 2**63, 20000).astype(np.uint64)).mean() < 0.02
