import random

from quillgraph.operators.ingest import leaks


def test_leaks_with_and_without_the_bit_set_and_what_travels(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["alpha", "beta", "Gamma", "délta", "x1"])
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(80)]
    items = [texts[3][:90], texts[9], "Alpha beta", "", " ".join(f"w{i}" for i in range(30))]
    texts += [texts[9].upper().replace(" ", ", "), "w3 w4 w5 w6 w7 w8 w9 w10", "w3 w4 w5 w6 w7 w8 w9", ""]
    docs = spark.createDataFrame([(f"d{i:02}", t) for i, t in enumerate(texts)], "doc string, markdown string").repartition(3)
    banned = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(items)], "item string, text string")
    runs = lambda t: {tuple(w[i : i + 4]) for w in [t.lower().replace(",", "").split()] for i in range(len(w) - 3)}
    want = {(f"d{i:02}", f"i{k}") for i, t in enumerate(texts) for k, b in enumerate(items) if runs(t) & runs(b)}
    assert want and {tuple(r) for r in leaks(docs, banned, 4).collect()} == {tuple(r) for r in leaks(docs, banned, 4, filtered=False).collect()} == want
    assert leaks(docs, banned.where("false"), 4).isEmpty() and leaks(docs.where("false"), banned, 4).isEmpty()
