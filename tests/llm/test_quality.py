import random
import zlib

import numpy as np

from quillgraph.llm import op4_quality as op4


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    vocab = ["ab", "tion", "the", "of", "house", "river", "ünder", "longerword"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        good = rng.random() < 0.7
        if not good:
            kind = rng.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [words[0]] * len(words) if kind == 1 else [w + "%%%" for w in words]
        docs.append((i, " ".join(words), "en"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    extra = [(1000, None, "en"), (1001, "", "en"), (None, "the river", None), (5, "the house", "x"), docs[7]]
    d = spark.createDataFrame([(*r, 0.5) for r in docs + extra], "doc_id long, text string, lang string, score double").repartition(3)
    lab = spark.createDataFrame(labels + [(2, None, 1), (3, 7, 0), (None, 1, 0), (99999, 0, 0), labels[8]], "doc_id long, quality int, toxic int")
    rows = op4.score_quality(d, lab).collect()
    assert len(rows) == len(docs) + len(extra)
    truth = {i: q for i, q, _ in labels}
    test = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(test) > 50
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.95
    for r in rows:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    kept = op4.keep_quality(d, lab)
    assert kept.columns == d.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == sorted((r.doc_id or -1) for r in rows if r.predicted)


def test_no_labels_and_no_documents(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in op4.score_quality(d, none).collect()] == [0.5, 0.5]
    assert op4.score_quality(d.limit(0), none).collect() == []


def test_additive_tables_and_a_pair_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = op4.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_scores_are_the_tables_added_up():
    """Vectorised bin additions against a plain sum, entry by entry."""
    rng = np.random.default_rng(1)
    x = rng.random((500, 4))
    model = op4.fit(x, (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] > 0.4).astype(float))
    assert model.pairs
    probe = np.concatenate([rng.random((40, 4)) * 3 - 1, x[:10], np.array([[c[0] if len(c) else 0 for c in model.cuts]])])
    bin_of = lambda cut, v: sum(c <= v for c in cut)
    for row, got in zip(probe.tolist(), model.score(probe).tolist(), strict=True):
        z = model.intercept + sum(t[bin_of(c, v)] for c, t, v in zip(model.cuts, model.tables, row, strict=True))
        z += sum(t[bin_of(a, row[i]), bin_of(b, row[j])] for i, j, a, b, t in model.pairs)
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-12


def test_clashing_names_and_a_small_sample(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame([(*r, 0.5, "q") for r in docs], "doc_id long, text string, x string, quality_score double, Quality_Score_ string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = op4.keep_quality(d, lab, sample=60)
    assert kept.columns == d.columns
    assert {r.quality_score for r in kept.collect()} == {0.5} and 0 < kept.count() < 200
