r"""Benchmark decontamination by winnowing.

The smallest hash among the GRAM-word grams of a 13-word window is its fingerprint,
so two equal windows always share it. The fingerprints of the items' windows are
joined with those of the documents' windows, and a hit is extended to the whole
window: its words are compared with those of the items' windows, as bytes; of the windows
with a common fingerprint only those of one hash of all words are compared. Items of
fewer words than a window are one window of their own length, its fingerprint that of
all its words.

The benchmark is the small side: it is read in blocks of a stated size, each sent to
all tasks, and the documents are never shuffled. Blocks are sent one after another, and
the few documents that were hit are merged by key afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import U

#: Words of a window.
WINDOW = 13
#: log2 of the words of a gram.
GRAM_BITS = 3
#: Bytes of items sent to the tasks at once.
BLOCK_BYTES = 16 << 20

_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_LOWER = shared.lower_ascii()


def _words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, memoryview]:
    """Hashes of the words, the row offsets among them, and the words as bytes with a space after each: starts, ends, buffer."""
    flat = _LOWER[flat]
    starts, ends, rows = shared.word_spans(flat, offsets, shared.ALNUM_WORD)
    sizes = ends - starts + 1
    close = np.cumsum(sizes)
    packed = flat[np.minimum(np.repeat(starts - (close - sizes), sizes) + np.arange(int(close[-1]) if len(close) else 0), max(0, len(flat) - 1))]
    packed[close - 1] = 0x20
    return shared.span_hashes(flat, starts, ends), rows, close - sizes, close - 1, memoryview(packed)


def _whole(levels: list[np.ndarray], size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, from two grams that cover it."""
    bits = size.bit_length() - 1
    grams, rest = levels[bits], size - (1 << bits)
    n = len(levels[0]) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return shared.mix(grams[:n] + shared.mix(grams[rest : rest + n]) * U(3) + U(size))


def _prints(levels: list[np.ndarray], size: int, mask: np.uint64) -> np.ndarray:
    """The fingerprint of each run of ``size`` words."""
    return (fingerprints(levels) if size == WINDOW else _whole(levels, size)) & mask


@dataclass
class Windows:
    """An items' block's windows of one length: their fingerprints, and sorted by a hash of the whole window that hash, place and item of each."""

    prints: np.ndarray
    whole: np.ndarray
    begin: np.ndarray
    close: np.ndarray
    item: np.ndarray


class Items:
    """The windows of a block of items as sorted arrays beside the items' packed words: some four times the text's bytes, here and in every task."""

    def __init__(self, ids: list[str], texts: list[str | None], bits: int = 64):
        self.mask = U((1 << bits) - 1)
        flat, offsets = shared.text_array(pa.array(texts, pa.string()))
        base, rows, begin, close, packed = _words(flat, offsets)
        levels = shared.gram_levels(base, GRAM_BITS)
        sizes = np.diff(rows)
        self.ids, self.packed = np.array(ids, dtype=object), np.frombuffer(packed, np.uint8)
        item = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.windows: dict[int, Windows] = {}
        for size in sorted({min(WINDOW, n) for n in sizes.tolist() if n}):
            hashes = _prints(levels, size, self.mask)
            own = item[: len(hashes)]
            fits = (sizes[own] >= size) if size == WINDOW else (sizes[own] == size)
            at = np.flatnonzero(fits & (np.arange(len(hashes)) + size <= rows[own + 1]))
            whole = _whole(levels, size)[at] & self.mask
            by = np.argsort(whole, kind="stable")
            at, whole = at[by], whole[by]
            self.windows[size] = Windows(np.unique(hashes[at]), whole, begin[at].astype(np.int32), close[at + size - 1].astype(np.int32), item[at])

    def holding(self, w: Windows, lo: int, hi: int, text: memoryview) -> set[int]:
        """The items of the windows lo to hi, all of one hash, whose words are the given ones."""
        raw = memoryview(self.packed)
        return {int(w.item[k]) for k in range(lo, hi) if raw[w.begin[k] : w.close[k]] == text}


def fingerprints(levels: list[np.ndarray]) -> np.ndarray:
    return shared.sliding_min(levels[GRAM_BITS], WINDOW - (1 << GRAM_BITS) + 1)


def _member(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, values)
    return (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == values) if len(keys) else np.zeros(len(values), bool)


def find_hits(items: Items, flat: np.ndarray, offsets: np.ndarray):
    """The words' row offsets, whether each word is hit, and the items of each row that has some."""
    base, rows, begin, close, packed = _words(flat, offsets)
    hit = np.zeros(len(base) + 1, dtype=np.int64)
    found: dict[int, set[int]] = {}
    if len(base):
        levels = shared.gram_levels(base, GRAM_BITS)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        for size, held in items.windows.items():
            hashes = _prints(levels, size, items.mask)
            at = np.arange(len(hashes))
            at = at[_member(held.prints, hashes) & (at + size <= rows[row[: len(at)] + 1])]
            whole = _whole(levels, size)[at] & items.mask
            lo, hi = np.searchsorted(held.whole, whole, "left"), np.searchsorted(held.whole, whole, "right")
            at, lo, hi = (x[hi > lo] for x in (at, lo, hi))
            met = []
            for place, a, z, r, x, y in zip(at.tolist(), begin[at].tolist(), close[at + size - 1].tolist(), row[at].tolist(), lo.tolist(), hi.tolist(), strict=True):
                own = items.holding(held, x, y, packed[a:z])
                if own:
                    met.append(place)
                    found.setdefault(r, set()).update(own)
            met = np.array(met, np.int64)
            np.add.at(hit, met, 1)
            np.add.at(hit, met + size, -1)
    return rows, np.cumsum(hit[:-1]) > 0, found


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _judge(n_words, n_hit, ids) -> tuple:
    return n_words, n_hit, len(ids), _digest(ids), bool(n_hit and 20 * n_hit >= n_words)


_FIELDS = [f.split() for f in _RESULT.split(", ")]


def _append(batch: pa.RecordBatch, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    columns = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), _FIELDS, strict=True)]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])


def _ids_of(items: Items, found: dict[int, set[int]]) -> dict[int, list[str]]:
    return {r: sorted({items.ids[i] for i in own}) for r, own in found.items()}


def _mark(sent, names: list[str]):
    def run(batches) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for b in shared.blocks(batches):
            rows, hit, found = find_hits(items, *shared.text_array(b.column("text")))
            sums = np.append(0, np.cumsum(hit))
            ids = _ids_of(items, found)
            yield _append(b, [_judge(n, h, ids.get(i, [])) for i, (n, h) in enumerate(zip(np.diff(rows).tolist(), (sums[rows[1:]] - sums[rows[:-1]]).tolist(), strict=True))], names)

    return run


_PART = "key string, hit binary, items array<string>"


def _part(sent):
    """Only the documents that a block hits: key, places of hit words, items."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for b in shared.blocks(batches):
            rows, hit, found = find_hits(items, *shared.text_array(b.column("text")))
            ids = _ids_of(items, found)
            at = sorted(ids)
            places = [np.flatnonzero(hit[rows[r] : rows[r + 1]]).astype(np.int64).tobytes() for r in at]
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at, pa.int64())), pa.array(places, pa.binary()), pa.array([ids[r] for r in at], pa.list_(pa.string()))], ["key", "hit", "items"])

    return run


def _merge(table: pa.Table) -> pa.Table:
    hit = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in table.column("hit").to_pylist()]))
    return pa.table({"key": table.column("key")[:1], "hit": pa.array([hit.tobytes()], pa.binary()), "items": pa.array([sorted({i for x in table.column("items").to_pylist() for i in x})], pa.list_(pa.string()))})


def _count(names: list[str], hit_name: str, items_name: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in shared.blocks(batches):
            _, rows, *_ = _words(*shared.text_array(b.column("text")))
            out = []
            for n, hit, ids in zip(np.diff(rows).tolist(), b.column(hit_name).to_pylist(), b.column(items_name).to_pylist(), strict=True):
                out.append(_judge(n, len(hit or b"") // 8, ids or []))
            yield _append(b.drop_columns([hit_name, items_name]), out, names)

    return run


def _marked(docs: DataFrame, benchmark: DataFrame, block_bytes: int, bits: int) -> tuple[DataFrame, list[str]]:
    """docs with the result columns, and the names these got so that none clashes."""
    spark = docs.sparkSession
    shared.ready(spark)
    names = [shared.fresh(n, docs.columns) for n, _ in _FIELDS]
    texts = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text").where("text is not null")
    blocks = max(1, -(-shared.text_bytes(texts) // block_bytes))

    def block(n: int):
        part = texts.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == n) if blocks > 1 else texts
        rows = part.collect()  # of block_bytes of text or so
        return spark.sparkContext.broadcast(Items([r["id"] for r in rows], [r["text"] for r in rows], bits))

    added = ", ".join(f"`{n}` {k}" for n, (_, k) in zip(names, _FIELDS, strict=True))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    if blocks == 1:
        return docs.mapInArrow(_mark(block(0), names), f"{fields}, {added}"), names
    key, hit, items = (shared.fresh(n, docs.columns) for n in ("key", "hit", "items"))
    own = F.sha2(F.concat_ws("\x00", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 256)
    found = None
    for n in range(blocks):
        sent = block(n)
        part = docs.select(own.alias("key"), "text").mapInArrow(_part(sent), _PART).checkpoint()
        sent.unpersist()
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("key").applyInArrow(_merge, _PART).select(F.col("key").alias(key), F.col("hit").alias(hit), F.col("items").alias(items))
    joined = docs.withColumn(key, own).join(merged, key, "left").select(*(F.col(f"`{c}`") for c in docs.columns), hit, items)
    return joined.mapInArrow(_count(names, hit, items), f"{fields}, {added}"), names


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, bits: int = 64) -> DataFrame:
    r"""The documents with n_words, n_hit, n_items, items_sha256 and contaminated.

    A-Z are lower-cased, words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``. A word is hit if it lies
    in an occurrence of a window of an item; a document is contaminated if it has hits and they
    are a twentieth of its words at least. Texts that are null or without words have no hits;
    items without words no windows; items that repeat an id count once, and a null item_id
    counts as the empty string. Columns of docs with the names of the result's are replaced by
    them; any other column stays. Repeated rows get equal results; an empty benchmark hits
    nothing; no documents give no rows. A text is worked on whole, at some hundred times its
    bytes. ``bits``: of the fingerprints; the result does not depend on it.
    """
    rows, names = _marked(docs, benchmark, block_bytes, bits)
    given = {n for n, _ in _FIELDS}
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in given), *(F.col(f"`{n}`").alias(f) for n, (f, _) in zip(names, _FIELDS, strict=True)))


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with all their columns; as mark_contaminated."""
    rows, names = _marked(docs, benchmark, block_bytes, 64)
    return rows.where(~F.col(f"`{names[-1]}`")).select(*(F.col(f"`{c}`") for c in docs.columns))
