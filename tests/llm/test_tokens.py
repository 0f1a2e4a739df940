import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from quillgraph.llm import op6_tokens as op6

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(text):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    plain.t = getattr(plain, "t", None) or Tokenizer.from_file(PATH)
    return plain.t.encode(text or "", add_special_tokens=False).ids


def rows():
    rng = random.Random(4)
    bits = ["the", "Foo's", "x1", "été", " ", "  ", "\n", "\t", " ", " ", "'ll", "#", "日本", "🙂", "-", "12", "\u0085", "<|endoftext|>", "ÿ", "'s", "\x00"]
    out = [(i, "".join(rng.choice(bits) + rng.choice([" ", "", " "]) for _ in range(rng.randint(0, 60)))) for i in range(-20, 200, 2)]
    return out + [(500, None), (501, ""), (None, "no id"), (7, "twice a"), (7, "twice a"), (7, "other"), (1001, "word " * 30000)]


def test_round_trip(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, path string").repartition(7)
    out = str(tmp_path / "tokens")
    op6.write_tokens(df, out, PATH, shard_bytes=2000)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in op6.read_tokens(spark, out).collect())
    want, at = [], 0
    for i, text in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*plain(text), 2]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    found = {r.doc_id: r.ids for r in op6.fetch_ids(spark, out, [0, 1001, 3, 10**15]).collect()}
    assert found == {0: [*plain(dict(data)[0]), 2], 1001: [*plain("word " * 30000), 2]}


def test_empty(spark):
    assert op6.token_rows(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).integers(-(2**62), 2**62, n)
    levels = op6.build_hash(keys)
    assert sorted(op6.find_slots(levels, keys).tolist()) == list(range(n))


def test_wide_ids_and_ties(spark, tmp_path):
    """An end id beyond two bytes makes ids of four; rows of one doc_id, and without any, spread over shards."""
    data = [(None, f"{i} none {i % 7}") for i in range(300)] + [(5, f"{i} five") for i in range(300)] + [(9, "same")] * 50
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    out, end = str(tmp_path / "wide"), 70000
    op6.write_tokens(df, out, PATH, end_id=end, shard_bytes=900)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in op6.read_tokens(spark, out, end_id=end).collect())
    want, at = [], 0
    for i, text in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*plain(text), end]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    found = op6.fetch_ids(spark, out, [5, 6], end_id=end).collect()
    assert sorted(r.ids for r in found) == sorted([*plain(t), end] for i, t in data if i == 5)
    names = [f for f in os.listdir(out) if f.startswith("part-")]
    assert len(names) > 6
    assert 1 < len(op6.shards_of(spark, out, [5])) < len(names)


def test_lookup_opens_few_shards(spark, tmp_path):
    out = str(tmp_path / "many")
    op6.write_tokens(spark.range(400).selectExpr("id * 3 AS doc_id", "concat('text of ', id) AS text"), out, PATH, shard_bytes=400)
    names = [f for f in os.listdir(out) if f.startswith("part-")]
    assert len(names) > 10
    assert len(op6.shards_of(spark, out, [300])) <= 2
    assert op6.fetch_ids(spark, out, [300]).collect()[0].ids == [*plain("text of 100"), 2]
    assert op6.fetch_ids(spark, out, []).collect() == []
    with pytest.raises(ValueError):
        op6.write_tokens(spark.createDataFrame([(1, "x")], "doc_id long, text string"), out + "2", PATH, end_id=2**32)
