import os
import re

import corpus_pipeline
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages_against_their_rules(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        rows = out.collect()
        seen[name] = rows
        if name != "tokens":
            assert out.columns == columns
            before = {r.doc_id for r in docs.collect()}
            assert {r.doc_id for r in rows} <= before and len(rows) < len(before)
            docs = spark.createDataFrame(rows, docs.schema).repartition(3)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen["quality"]}
    assert sum((i in kept) == bool(q) for i, q in labels.items()) >= 0.95 * len(labels)
    # Near-duplicates: no two kept documents are similar, by brute force.
    shingles = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))
    sets = [shingles(r.text) for r in seen["near_dedup"]]
    assert not any(a and b and 5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert sorted(r.doc_id for r in seen["tokens"]) == sorted(r.doc_id for r in seen["mixing"])


def test_run_gives_the_rows_of_the_stages(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "start", "n_tokens", "ids_crc32"}
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert [s for s, _ in starts] == [sum(n for _, n in starts[:i]) for i in range(len(starts))]
