"""The byte and the word operator against brute force."""

import hashlib
import random

import pytest

from quillgraph.llm.op1_substrings import remove_repeated_substrings
from quillgraph.llm.op2_windows import remove_repeated_windows

SCHEMA = "doc_id long, text string, uid string"


def brute(rows, window, split, join):
    seen, out = set(), {}
    for key in sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        units = split(key[1].encode())
        gone = [False] * len(units)
        for i in range(len(units) - window + 1):
            w = join(units[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        kept = join([u for u, g in zip(units, gone) if not g])
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(units), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return sorted((r[0] is not None, r[0] or 0, *out[r[0], r[1] or ""]) for r in rows)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    words = lambda n: rng.choice([" ", " ", " ", "\n", "  "]).join(rng.choice(vocab) for _ in range(n))
    passages = [words(rng.randint(15, 60)) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(passages) if rng.random() < 0.4 else words(rng.randint(1, 50)))
        text = rng.choice([" ", "\n"]).join(parts)
        if rng.random() < 0.3 and len(text) > 30:
            k = rng.randrange(len(text))
            text = text[:k] + "Z" + text[k + 1 :]
        rows.append((i * 3, text))
    rows += [(400 + i, rows[i][1]) for i in range(20)]
    rows += [(500, None), (501, ""), (None, passages[0] * 2), (502, "x" * 700), (503, "ab " * 300), (504, "x" * 400)]
    rows += [rows[5], rows[5], (505, " ".join(f"w{i}" for i in range(6000))), (506, " ".join(f"w{i}" for i in range(100, 5000)))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "bits"), [(1, 64), (2, 8)])
def test_bytes(spark, seed, bits):
    """Also with routing hashes of 8 bits, which all collide."""
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(5)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated_substrings(df, bits=bits).collect())
    assert got == brute(rows, 100, lambda b: [b[i : i + 1] for i in range(len(b))], b"".join)


@pytest.mark.parametrize(("seed", "bits"), [(1, 64), (2, 8)])
def test_words(spark, seed, bits):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(5)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated_windows(df, bits=bits).collect())
    assert got == [(*r[:4], r[5]) for r in brute(rows, 20, bytes.split, b" ".join)]


def test_empty_tables_and_texts(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert remove_repeated_substrings(none).collect() == []
    assert remove_repeated_windows(none).collect() == []
    df = spark.createDataFrame([(1, "a b " * 60, "")], SCHEMA)
    assert bytes(remove_repeated_substrings(df, texts=True).first().kept) == b"a b "
    assert remove_repeated_windows(df, texts=True).first().kept.split() == ["a", "b"]


def test_a_text_of_several_megabytes(spark):
    """One text far over a block: words that never repeat, then a copy of its first 200."""
    words = [f"w{i}" for i in range(400_000)]
    text = " ".join(words + words[:200])
    df = spark.createDataFrame([(1, text, ""), (2, "short", "")], SCHEMA)
    got = {r.doc_id: r for r in remove_repeated_windows(df).collect()}
    assert (got[1].n_words, got[1].n_removed, got[2].n_removed) == (400_200, 200, 0)
    assert got[1].kept_sha256 == hashlib.sha256(" ".join(words).encode()).hexdigest()
    got = {r.doc_id: r for r in remove_repeated_substrings(df).collect()}
    same = len(" ".join(words[:200]))
    assert same <= got[1].n_removed <= same + 2 and got[1].n_spans == 1


def test_more_tasks_than_the_session_has(spark, monkeypatch):
    """Small buckets make more partitions than the session's shuffles have."""
    from quillgraph.llm import repeats

    monkeypatch.setattr(repeats, "BUCKET_BYTES", 1000)
    rows = corpus(3)
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(5)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeated_windows(df).collect())
    assert got == [(*r[:4], r[5]) for r in brute(rows, 20, bytes.split, b" ".join)]
