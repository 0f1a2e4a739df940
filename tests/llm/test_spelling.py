import random
import zlib
from collections import Counter

import pytest

from quillgraph.llm import op11_spelling as op


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for m in op.RUN.finditer(text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in m[0])
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    form, size = {}, {}
    for w in words:
        found = sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v))
        size[w] = len(found)
        form[w] = found[0] if found and words[found[0]] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], size[w], words.get(form[w])))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    docs = spark.createDataFrame([(i, t, "w", 9) for i, t in rows], "doc_id long, text string, word string, n long").repartition(parts)
    return sorted((tuple(r) for r in op.variants(docs).collect()), key=str)


@pytest.mark.parametrize("long", [op.LONG, 7])
def test_against_brute_force(spark, monkeypatch, long):
    """With LONG at 7 most words go by digests of their keys."""
    monkeypatch.setattr(op, "LONG", long)
    rng = random.Random(11)
    base = ["letter", "lettter", "aaaaaa", "aaaaaaa", "aaaaaaaa", "straße", "Straße", "mañana", "manana", "xxxxxxxy", "abcdefgh", "abcdefghi", "ÀÉÈÇÑÖ"]
    bag = []
    for w in base:
        bag += [w] * rng.choice([5, 30, 200])
        for _ in range(12):
            k, c = rng.randrange(len(w) + 1), rng.choice("abzéß")
            bag += [rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])] * rng.choice([4, 5, 6, 40])
    rng.shuffle(bag)
    rows = [(i, rng.choice([" ", "-", "1", "\n"]).join(bag[i * 40 : i * 40 + 40]).replace("letter", rng.choice(["letter", "LETTER"]))) for i in range(len(bag) // 40)]
    rows += [(None, "letter lettez"), (5000, None), (5001, ""), rows[0], rows[0], (2**62, "Letter " * 4000)]
    assert run(spark, rows) == brute(rows)


def test_long_words_and_their_border(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(n)) for n in (62, 63, 64, 65, 66, 4000)]
    words += [w[:9] + w[10:] for w in words] + [w[:20] + "z" + w[20:] for w in words] + [w[:30] + "q" + w[31:] for w in words] + [words[0][:-1], "b" * 64, "b" * 65, "b" * 66]
    rows = [(i, " ".join(words)) for i in range(5)] + [(9, " ".join(words[:6] * 30))]
    assert run(spark, rows, 2) == brute(rows)


def test_empty_tables(spark):
    assert run(spark, [], 1) == [] and run(spark, [(1, None), (2, "short words")], 1) == []


def test_chains_lead_to_the_last_form(spark):
    rows = [(1, " ".join(["planetary"] * 700 + ["planetery"] * 120 + ["planetory"] * 5 + ["plenetery"] * 20 + ["plenitery"] * 4))]
    found = {r[0]: r for r in run(spark, rows, 1)}
    assert found["plenetery"][1:3] == ("planetery", "planetary") and found["planetory"][1] == "planetary"
