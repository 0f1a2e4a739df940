"""Spelling variants: words one edit apart, each led to its most frequent form.

Two words differ by one replacement if they share a wildcard group: the position, what stands
before it and what stands after it. A group is known by its size and its two top words: a member
has size - 1 near words in it, the best of which is the top word, or the second for the top word
itself. Two words differ by one indel if the longer one without a character is the shorter one: the
deletions of all words meet the vocabulary. Both are one shuffle of 2 x length + 1 keys for each
word and a window over each key; pairs are never formed.

Words are known by their rank in the order of falling count, then of code points, so the best of
some words is the least number, and a key's row is the key and a number.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

#: Fixed by the contract: what runs are made of, the noise's divisor, and what is a word and a form.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
NOISE, SHORTEST, LEAST, TIMES = 199, 6, 5, 5
#: Words longer than this have digests as keys instead of strings; so a key has a bounded size.
LONG = 64
#: Different words that a task counts before it sends them on.
HELD = 200_000

_UPPER = {c: c + 32 for c in range(65, 91)}
_PRIMES = (2**61 - 1, 2**89 - 1)


def noisy(doc_id: int | None, run: str) -> str:
    """The run, lower-cased in A-Z, without one character if the document's hash for it says so."""
    h = zlib.crc32(run.encode(), zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id))
    if h % NOISE:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    size = 0
    for b in shared.blocks(batches):
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            for run, n in Counter(m[0] for m in RUN.finditer(text.translate(_UPPER))).items() if text else ():
                word = noisy(doc_id, run)
                if len(word) >= SHORTEST:
                    held[word] += n
                    size += len(word)
                    if len(held) >= HELD or size > 1 << 26:
                        yield rows()
                        size = 0
    if held:
        yield rows()


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """word, n: how often each word of at least SHORTEST characters occurs in all texts, if ``least`` times or more."""
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _short_keys() -> Column:
    """The keys of a word: itself, its wildcards, and its deletions (one of each run of equal characters)."""
    places = "sequence(1, char_length(word))"
    wild = f"transform({places}, i -> concat(substr(word, 1, i - 1), '*', substr(word, i + 1)))"
    cut = f"transform(filter({places}, i -> substr(word, i, 1) != substr(word, i + 1, 1)), i -> concat(substr(word, 1, i - 1), substr(word, i + 1)))"
    return F.expr(f"concat(array(struct(word as key, 0 as kind)), transform({wild}, k -> struct(k as key, 1 as kind)), transform(case when char_length(word) > {SHORTEST} then {cut} else array() end, k -> struct(k as key, 2 as kind)))")


def _long_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for long words, each key as two polynomials of what stands before and after, so a word costs its length.

    A string is known by its length and its polynomials, so a deletion and the shorter word give one key.
    """

    def keys(word: str) -> Iterator[tuple[str, int]]:
        n, parts = len(word), []
        for p in _PRIMES:
            powers, before = [1], [0]
            for c in map(ord, word):
                before.append((before[-1] * 1_000_003 + c) % p)
                powers.append(powers[-1] * 1_000_003 % p)
            parts.append((p, powers, before))

        def joined(i: int, middle: tuple[int, ...]) -> list[int]:
            out = []
            for p, powers, before in parts:
                h = before[i]
                for c in middle:
                    h = (h * 1_000_003 + c) % p
                after = (before[n] - before[i + 1] * powers[n - i - 1]) % p
                out.append((h * powers[n - i - 1] + after) % p)
            return out

        whole = [before[n] for _, _, before in parts]
        yield f"{n}#{whole[0]:x}#{whole[1]:x}", 0
        for i in range(n):
            a, b = joined(i, (42,))
            yield f"{n}*{i}*{a:x}*{b:x}", 1
            if i + 1 == n or word[i] != word[i + 1]:
                a, b = joined(i, ())
                yield f"{n - 1}#{a:x}#{b:x}", 2

    out: list[tuple[str, int, int]] = []

    def rows() -> pa.RecordBatch:
        k, kind, r = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(kind, pa.int32()), pa.array(r, pa.int64())], ["key", "kind", "r"])

    for b in batches:
        for r, word in zip(b.column("r").to_pylist(), b.column("word").to_pylist(), strict=True):
            for key, kind in keys(word):
                out.append((key, kind, r))
                if len(out) >= 50_000:
                    yield rows()
                    out = []
    if out:
        yield rows()


def keyed(words: DataFrame) -> DataFrame:
    """key, kind (0 the word, 1 a wildcard, 2 a deletion), r. words: r, word.

    A word of LONG + 1 characters gives its deletions as strings too, which meet words of LONG.
    """
    size = F.char_length("word")
    short = words.where(size <= LONG).select("r", F.explode(_short_keys()).alias("k")).select("k.key", "k.kind", "r")
    edge = words.where(size == LONG + 1).select("r", F.explode(_short_keys()).alias("k")).where("k.kind = 2").select("k.key", "k.kind", "r")
    return short.unionByName(edge).unionByName(words.where(size > LONG).mapInArrow(_long_keys, "key string, kind int, r long"))


def near(keys: DataFrame) -> DataFrame:
    """r, n_near, best: how many words are near, and the least rank of these; words without one are missing."""
    group = Window.partitionBy("key")
    ranked = group.orderBy("r")
    of = lambda kind: F.when(F.col("kind") == kind, F.col("r"))
    seen = keys.select(
        "kind", "r",
        F.row_number().over(ranked).alias("at"), F.lead("r").over(ranked).alias("second"),
        F.count("*").over(group).alias("size"), F.min("r").over(group).alias("top"),
        F.max(of(0)).over(group).alias("self"), F.count(of(2)).over(group).alias("cuts"), F.min(of(2)).over(group).alias("top_cut"),
    ).where("size > 1 and (kind = 1 or self is not null)")
    case = lambda wild, own, cut: F.when(F.col("kind") == 1, wild).when(F.col("kind") == 0, own).otherwise(cut)
    found = seen.select("r", case(F.col("size") - 1, F.col("cuts"), F.lit(1)).alias("k"), case(F.when(F.col("at") == 1, F.col("second")).otherwise(F.col("top")), F.col("top_cut"), F.col("self")).alias("b"))
    return found.groupBy("r").agg(F.sum("k").alias("n_near"), F.min("b").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """r, root: the end of each word's chain of forms, by pointer doubling. forms: r, form. A form counts TIMES as often, so chains are short and end."""
    chain = forms.select("r", F.col("form").alias("root")).checkpoint()
    while True:
        ahead = chain.select(F.col("r").alias("root"), F.col("root").alias("beyond"))
        longer = chain.join(ahead, "root", "left").select("r", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")).checkpoint()
        if longer.where("moved").isEmpty():
            return chain
        chain = longer.drop("moved")


def variants(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n.

    docs: doc_id, text; other columns are ignored. A null or empty text has no words; a null
    doc_id counts as the empty string where runs are hashed; repeated rows count each. No
    documents give no words. Ties between near words go to the smaller in code-point order.
    """
    shared.ready(docs.sparkSession)
    counted = vocabulary(docs, least).checkpoint()
    words = counted.orderBy(F.col("n").desc(), "word").select("word", "n", F.monotonically_increasing_id().alias("r")).checkpoint()
    found = near(keyed(words.select("r", "word")))
    best = words.select(F.col("r").alias("best"), F.col("n").alias("best_n"), F.col("word").alias("best_word"))
    linked = words.join(found, "r", "left").join(best, "best", "left")
    is_form = F.col("best_n") >= times * F.col("n")
    linked = linked.select("r", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form_r"), F.when(is_form, F.col("best_word")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")).checkpoint()
    ends = roots(linked.where("form_r is not null").select("r", F.col("form_r").alias("form")))
    ends = ends.join(words.select(F.col("r").alias("root"), F.col("word").alias("root_word")), "root").select("r", "root_word")
    return linked.join(ends, "r", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
