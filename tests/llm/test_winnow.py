import hashlib
import random
import re

import pytest

from quillgraph.llm.op10_winnow import keep_clean, mark_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    ids |= windows[x]
        out.append((d is not None, d or 0, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["alpha", "Bé", "c3", "ñandú", "Dog", "x", "日本", "the", "of", "0"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 13, 14, 40, 80, 9, 12]))) for i in range(30)] + [(40, None), (None, text(20)), (5, text(30)), (41, "uniqueword"), (42, "two words")]
    docs = []
    for i in range(150):
        t = text(rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            w = words(rng.choice(items)[1])
            k = rng.randrange(len(w) + 1)
            t += " ".join(w[k : k + rng.randint(5, 30)]).upper().replace("É", "é").replace("Ñ", "ñ").replace("Ú", "ú") + rng.choice([" ", ". "]) + text(rng.randint(0, 40))
        docs.append((i, t))
    return [*docs, (200, None), (201, ""), (None, items[3][1]), docs[3], docs[3], (202, "a Uniqueword b " + "zz " * 40)], items


@pytest.mark.parametrize(("block", "bits"), [(1 << 24, 64), (700, 64), (1 << 24, 8)])
def test_against_brute_force(spark, block, bits):
    """In one block and several, and with fingerprints of 8 bits, which all collide."""
    docs, items = corpus(block)
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, source string").repartition(3)
    got = mark_contaminated(df, spark.createDataFrame(items, "item_id long, text string"), block, bits)
    assert got.columns[:3] == df.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == brute(docs, items)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert mark_contaminated(none, items).collect() == []
    assert mark_contaminated(spark.createDataFrame([(1, "a b c")], none.schema), items.limit(0)).first().n_hit == 0


@pytest.mark.parametrize("block", [1 << 24, 30])
def test_clashing_names(spark, block):
    """Result columns replace those of their names; helpers' names may be taken; the filter keeps all columns as they were."""
    names = ["doc_id", "text", "n_words", "N_Hit", "items_sha256", "contaminated", "key", "hit", "items", "n_items"]
    item = " ".join(f"b{i}" for i in range(13))
    rows = [(1, f"x {item} y", "w", "h", "s", "c", "k", "t", "i", "n"), (2, "clean text", "w", "h", "s", "c", "k", "t", "i", "n"), (2, "clean text", "w", "h", "s", "c", "k", "t", "i", "n")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    items = spark.createDataFrame([(1, item), (2, "other words here of an item"), (3, "still more")], "item_id long, text string")
    got = mark_contaminated(df, items, block)
    assert got.columns == ["doc_id", "text", "key", "hit", "items", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((r.doc_id, r.key, r.n_words, r.n_hit, r.contaminated) for r in got.collect()) == [(1, "k", 15, 13, True), (2, "k", 2, 0, False), (2, "k", 2, 0, False)]
    kept = keep_clean(df, items, block)
    assert kept.columns == names and [tuple(r) for r in kept.collect()] == rows[1:]


def test_a_block_of_items_takes_little_memory():
    """16 MB of items: the arrays that every task gets."""
    import pickle

    from quillgraph.llm.op10_winnow import BLOCK_BYTES, Items

    rng = random.Random(2)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(2, 9) + str(rng.randint(0, 99)) for _ in range(300))
    texts = [text[k % 700 :] + f" {k}" for k in range(BLOCK_BYTES // (len(text) - 350))]
    items = Items([str(k) for k in range(len(texts))], texts)
    assert len(items.windows[13].whole) > 1_500_000 and len(pickle.dumps(items)) < 100 << 20
