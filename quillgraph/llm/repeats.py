"""Distributed search for repeated windows, shared by the byte and the word operator.

A *unit* is a byte or a word; a *window* is T consecutive units of one document.
A window is repeated if the same T units also start earlier (smaller document,
or same document and earlier start). The plan never holds all windows:

1. announce  every window has a minimiser, the smallest hash among its grams of
   M units. Consecutive windows with one minimiser form a segment. A segment
   travels as its minimiser, a 128-bit BLAKE2b digest of its packed string, and
   a place. Segments equal to an earlier one of the same task are settled there,
   so a hot passage sends one row a task.
2. settle    a bucket of minimisers is sorted: a segment equal to an earlier
   one repeats whole (equal means an equal digest); where different segments
   share a minimiser, the first of each is asked for its text. A minimiser that
   stands in no second segment cannot repeat, and its text never travels.
3. cut       the asked segments are cut from the texts in two packed strings,
   for windows that reach left or right of the minimiser by half the rest, and
   sent to the bucket of that longer gram.
4. verify    a bucket's different strings are compared window by window, by the
   method of the operator (``Units.repeated``), on the strings themselves.
5. finish    the repeated windows meet the texts again and are removed.

Places are (uid, th, start): the document id (a null id counts as the smallest),
the hash of the text (which tells apart rows that share an id; repeated rows are
one document and get one result each), and the window's first unit.

The hashes that choose buckets only bring strings together: fewer of their bits cost
time, never a result (``bits``; a test runs with 8).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import U

#: Segments that a task gathers before it sends them.
HELD = 1_000_000
#: Bytes of text of a bucket, and buckets of a task.
BUCKET_BYTES, BUCKETS = 8 << 20, 4

_SENT = "bucket int, kind int, anchor binary, one binary, two binary, uid binary, th binary, start binary, n binary, lead binary"
_CUT = "bucket int, key binary, uid binary, th binary, start binary, size binary, text binary"
_SETTLED, _ASKED = 0, 1


class Units:
    """What the byte and the word operator differ in."""

    window: int
    #: log2 of the gram length.
    gram_bits: int
    result: str

    @property
    def gram(self) -> int:
        return 1 << self.gram_bits

    @property
    def half(self) -> int:
        return (self.window - self.gram) // 2

    def units(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A hash of each unit, the row offsets among the units, and packed bytes with the start and end of each unit in them."""
        raise NotImplementedError

    def split(self, text: bytes):
        """The text as a sequence whose slices are runs of units."""
        raise NotImplementedError

    def pack(self, run) -> bytes:
        """A run of units as one string, equal only for equal runs."""
        raise NotImplementedError

    def repeated(self, strings: list[bytes], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(string, offset) of each window in the strings that also occurs at a smaller order.

        ``order``: of each string's first window; a later window's is larger by its offset.
        """
        raise NotImplementedError

    def row(self, text: bytes, covered: np.ndarray) -> tuple:
        """The result columns after doc_id; covered: (start, end) runs of removed units."""
        raise NotImplementedError


def segments(spec: Units, flat: np.ndarray, offsets: np.ndarray, mask: np.uint64):
    """The segments of a block of rows: gram hash, both halves of the digest, row, start, windows, and the gram's place in the segment."""
    base, rows, packed, begin, close = spec.units(flat, offsets)
    t, m = spec.window, spec.gram
    if len(base) < t:
        return None
    grams = shared.gram_levels(base, spec.gram_bits)[spec.gram_bits]
    # The low bits hold the place, so ties go to the leftmost gram.
    bits = U(max(1, int(len(grams)).bit_length()))
    keys = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    at = (shared.sliding_min(keys, t - m + 1) & ((U(1) << bits) - U(1))).astype(np.int64)
    n = len(at)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[:n]
    whole = np.arange(n) + t <= rows[row + 1]
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n)
    keep = whole[first]
    first, last = first[keep], last[keep]
    if not len(first):
        return None
    raw = memoryview(packed)
    digests = b"".join([blake2b(raw[a:z], digest_size=16).digest() for a, z in zip(begin[first].tolist(), close[last + t - 2].tolist(), strict=True)])
    one, two = np.frombuffer(digests, np.uint64).reshape(-1, 2).T
    return grams[at[first]] & mask, one, two, row[first], first - rows[row[first]], last - first, at[first] - first


def _deltas(x: np.ndarray) -> bytes:
    return np.diff(x, prepend=x.dtype.type(0)).tobytes()


def _message(bucket: int, kind: int, pick, anchor, one, two, uid, th, start, n, lead) -> tuple:
    """One row of _SENT; places as differences, which compress."""
    with np.errstate(over="ignore"):
        return (bucket, kind, *(None if x is None else x[pick].tobytes() for x in (anchor, one, two)), _deltas(uid[pick]), _deltas(th[pick]), _deltas(start[pick].astype(np.int32)), n[pick].astype(np.int32).tobytes(), None if lead is None else lead[pick].astype(np.int32).tobytes())


def _by_bucket(which: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(which, kind="stable")
    edges = np.flatnonzero(np.diff(which[order], prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
        yield int(which[order[a]]), order[a:b]


def _home(uid: np.ndarray, th: np.ndarray, count: int) -> np.ndarray:
    """The bucket of a document; _keyed() has the same rule."""
    return np.mod(uid ^ th, count)


def _keyed(docs: DataFrame, count: int) -> DataFrame:
    uid, th = F.coalesce(F.col("doc_id").cast("long"), F.lit(shared.NULL_ID)), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", "text", uid.alias("uid"), th.alias("th")).withColumn("bucket", F.pmod(F.col("uid").bitwiseXOR(F.col("th")), F.lit(count)).cast("int"))


def _changes(order, *columns):
    """Whether each row, in the order, differs from the one before it."""
    new = np.ones(len(order), dtype=bool)
    new[1:] = False
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return new


def _moved(uid, th, start, order):
    """Whether each place differs from the one before it in the order; a repeated row has the place of its twin."""
    return _changes(order, uid, th, start)


def _runs(uid, th, start, n):
    """Window ranges, joined where they touch."""
    order = np.lexsort((start, th, uid))
    uid, th, start, n = uid[order], th[order], start[order].astype(np.int64), n[order].astype(np.int64)
    if not len(uid):
        return uid, th, start, n
    fresh = np.empty(len(uid), dtype=bool)
    fresh[0] = True
    fresh[1:] = (uid[1:] != uid[:-1]) | (th[1:] != th[:-1]) | (start[1:] != start[:-1] + n[:-1])
    heads = np.flatnonzero(fresh)
    return uid[heads], th[heads], start[heads], np.add.reduceat(n, heads)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("anchor", "one", "two", "uid", "th", "start", "n", "lead"))])
_CUT_ARROW = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("key", "uid", "th", "start", "size", "text"))])


def announce(spec: Units, count: int, bits: int = 64):
    mask = U((1 << bits) - 1)

    def send(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, one, two, uid, th, start, n, lead = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((start, th, uid, two, one, anchor))
        first = _changes(order, anchor, one, two)
        mine = np.sort(order[first])
        mine = mine[np.lexsort((start[mine], th[mine], uid[mine]))]
        which = (anchor[mine] % U(count)).astype(np.int64)
        rows = [_message(b, _ASKED, mine[pick], anchor, one, two, uid, th, start, n, lead) for b, pick in _by_bucket(which)]
        rest = order[~first & _moved(uid, th, start, order)]
        if len(rest):
            u, t, s, k = _runs(uid[rest], th[rest], start[rest], n[rest])
            rows += [_message(b, _SETTLED, pick, None, None, None, u, t, s, k, None) for b, pick in _by_bucket(_home(u, t, count))]
        for i in range(0, len(rows), 64):
            yield _batch(rows[i : i + 64], _SENT_ARROW)

    def run(batches):
        held, have = [], 0
        for b in shared.blocks(batches):
            got = segments(spec, *shared.text_array(b.column("text")), mask)
            if got is None:
                continue
            anchor, one, two, row, start, n, lead = got
            held.append((anchor, one, two, b.column("uid").to_numpy()[row], b.column("th").to_numpy()[row], start.astype(np.int32), n.astype(np.int16), lead.astype(np.int16)))
            have += len(anchor)
            if have >= HELD:
                yield from send(held)
                held, have = [], 0
        if held:
            yield from send(held)

    return run


def _read(table: pa.Table, kind: int | None = None) -> list[np.ndarray] | None:
    """The columns of all messages of a kind, joined."""
    types = {"anchor": np.uint64, "one": np.uint64, "two": np.uint64, "uid": np.int64, "th": np.int64, "start": np.int32, "n": np.int32, "lead": np.int32}
    parts = {c: [] for c in types}
    kinds = table.column("kind").to_pylist()
    for c, dtype in types.items():
        for k, value in zip(kinds, table.column(c), strict=True):
            if kind is None or k == kind:
                raw = value.as_buffer()
                x = np.frombuffer(raw, dtype=dtype) if raw is not None else np.zeros(0, dtype)
                if c in ("uid", "th", "start"):
                    with np.errstate(over="ignore"):
                        x = np.cumsum(x, dtype=dtype)
                parts[c].append(x)
    return [np.concatenate(v) for v in parts.values()] if parts["uid"] else None


def settle(count: int):
    def run(table: pa.Table) -> pa.Table:
        out = []
        keep = table.filter(pa.compute.equal(table.column("kind"), _SETTLED))
        got = _read(table, _ASKED)
        if got is not None:
            anchor, one, two, uid, th, start, n, lead = got
            order = np.lexsort((start, th, uid, two, one, anchor))
            head = _changes(order, anchor)
            first = _changes(order, anchor, one, two)
            group = np.cumsum(head) - 1
            several = np.bincount(group, weights=first) > 1
            rest = order[~first & _moved(uid, th, start, order)]
            if len(rest):
                u, t, s, k = _runs(uid[rest], th[rest], start[rest], n[rest])
                out += [_message(b, _SETTLED, p, None, None, None, u, t, s, k, None) for b, p in _by_bucket(_home(u, t, count))]
            ask = order[first & several[group]]
            if len(ask):
                ask = ask[np.lexsort((start[ask], th[ask], uid[ask]))]
                out += [_message(b, _ASKED, ask[p], None, None, None, uid, th, start, n, lead) for b, p in _by_bucket(_home(uid[ask], th[ask], count))]
        made = pa.Table.from_batches([_batch(out, _SENT_ARROW)])
        return pa.concat_tables([keep.cast(_SENT_ARROW), made])

    return run


def _texts(table: pa.Table) -> dict[tuple[int, int], tuple[int, bytes]]:
    """Each different document of a bucket once, by place."""
    return {(u, t): x for u, t, x in zip(table.column("uid").to_pylist(), table.column("th").to_pylist(), table.column("text").cast(pa.large_binary()).to_pylist(), strict=True)}


def cut(spec: Units, count: int, bits: int = 64):
    mask = (1 << bits) - 1

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        got = _read(asked)
        rows: dict[int, list] = {}
        if got is not None:
            _, _, _, uid, th, start, n, lead = got
            order = np.lexsort((start, th, uid))
            texts, place, units = _texts(docs), None, b""
            t, m, h = spec.window, spec.gram, spec.half
            for u, x, s, k, g in zip(uid[order].tolist(), th[order].tolist(), start[order].tolist(), n[order].tolist(), lead[order].tolist(), strict=True):
                if (u, x) != place:
                    place, units = (u, x), spec.split(texts[u, x] or b"")
                p, last = s + g, s + k - 1
                # Windows that reach at least h units left of the gram, and the others.
                for lo, hi, a, b in ((s, min(last, p - h), p - h, p + m), (max(s, p - h + 1), last, p, p + m + h + 1)):
                    if lo <= hi:
                        key = xxhash.xxh3_64_intdigest(spec.pack(units[a:b]), seed=a == p) & mask
                        rows.setdefault(key % count, []).append((key, u, x, lo, spec.pack(units[lo : hi + t])))
        out = []
        for b, got_rows in rows.items():
            key, u, x, s, text = zip(*got_rows, strict=True)
            out.append((b, np.array(key, np.uint64).tobytes(), np.array(u, np.int64).tobytes(), np.array(x, np.int64).tobytes(), np.array(s, np.int64).tobytes(), np.array([len(y) for y in text], np.int64).tobytes(), b"".join(text)))
        return pa.Table.from_batches([_batch(out, _CUT_ARROW)])

    return run


def verify(spec: Units, count: int):
    def run(table: pa.Table) -> pa.Table:
        groups: dict[tuple[int, bytes], list] = {}
        for row in table.to_pylist():
            at = 0
            cols = [np.frombuffer(row[c], np.uint64 if c == "key" else np.int64).tolist() for c in ("key", "uid", "th", "start", "size")]
            for key, u, x, s, size in zip(*cols, strict=True):
                groups.setdefault((key, row["text"][at : at + size]), []).append((u, x, s))
                at += size
        repeated: list[tuple] = []
        kinds: dict[int, list] = {}
        for (key, text), places in groups.items():
            places.sort()
            first = places[0]
            if len(places) > 1:
                windows = len(spec.split(text)) - spec.window + 1
                repeated += [(*p, windows) for p in places[1:]]
            kinds.setdefault(key, []).append((first, text))
        compare = sorted(x for v in kinds.values() if len(v) > 1 for x in v)
        if compare:
            # Documents in order, with room for their starts.
            names = {p: i for i, p in enumerate(sorted({x[0][:2] for x in compare}))}
            order = np.array([(names[p[:2]] << 36) + p[2] for p, _ in compare], dtype=np.int64)
            which, offset = spec.repeated([text for _, text in compare], order)
            for i, o in zip(which.tolist(), offset.tolist(), strict=True):
                u, x, s = compare[i][0]
                repeated.append((u, x, s + o, 1))
        out = []
        if repeated:
            u, x, s, k = (np.array(c, dtype=np.int64) for c in zip(*repeated, strict=True))
            u, x, s, k = _runs(u, x, s, k)
            out = [_message(b, _SETTLED, p, None, None, None, u, x, s, k, None) for b, p in _by_bucket(_home(u, x, count))]
        return pa.Table.from_batches([_batch(out, _SENT_ARROW)])

    return run


def finish(spec: Units, schema: pa.Schema):
    def run(docs: pa.Table, settled: pa.Table) -> pa.Table:
        got = _read(settled)
        ranges: dict[tuple[int, int], np.ndarray] = {}
        if got is not None:
            _, _, _, uid, th, start, n, _ = got
            order = np.lexsort((start, th, uid))
            uid, th, start, n = uid[order], th[order], start[order].astype(np.int64), n[order].astype(np.int64)
            edge = np.flatnonzero((np.diff(uid, prepend=uid[0]) != 0) | (np.diff(th, prepend=th[0]) != 0))
            edge = np.unique(np.append(0, edge))
            for a, b in zip(edge, np.append(edge[1:], len(uid)), strict=True):
                s, e = start[a:b], start[a:b] + n[a:b] - 1 + spec.window
                reach = np.maximum.accumulate(e)
                head = np.append(True, s[1:] > reach[:-1])
                tail = np.append(np.flatnonzero(head)[1:] - 1, len(s) - 1)
                ranges[int(uid[a]), int(th[a])] = np.stack([s[head], reach[tail]], axis=1)
        none = np.zeros((0, 2), np.int64)
        rows = [(i, *spec.row(x or b"", ranges.get((u, t), none))) for i, u, t, x in zip(docs.column("doc_id").to_pylist(), docs.column("uid").to_pylist(), docs.column("th").to_pylist(), docs.column("text").cast(pa.large_binary()).to_pylist(), strict=True)]
        return pa.Table.from_batches([_batch(rows, schema)])

    return run


def remove_repeats(docs: DataFrame, spec: Units, bits: int = 64) -> DataFrame:
    """The plan above; one row per input row, with doc_id and the columns of ``spec.result``."""
    spark = docs.sparkSession
    shared.ready(spark)
    # At least as many buckets as the session's shuffles have partitions.
    count = shared.buckets(shared.text_bytes(docs), BUCKET_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = -(-count // BUCKETS)
    keyed = _keyed(docs, count)
    schema = pa.schema([("doc_id", pa.int64()), *((c.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in spec.result.split(", "))])
    sent = keyed.select("text", "uid", "th").mapInArrow(announce(spec, count, bits), _SENT)
    settled = shared.spread(sent, "bucket", parts).groupBy("bucket").applyInArrow(settle(count), _SENT).checkpoint()
    texts = shared.spread(keyed, "bucket", parts).groupBy("bucket")
    asked = shared.spread(settled.where(F.col("kind") == _ASKED), "bucket", parts).groupBy("bucket")
    strings = texts.cogroup(asked).applyInArrow(cut(spec, count, bits), _CUT)
    verified = shared.spread(strings, "bucket", parts).groupBy("bucket").applyInArrow(verify(spec, count), _SENT)
    repeats = shared.spread(settled.where(F.col("kind") == _SETTLED).unionByName(verified), "bucket", parts).groupBy("bucket")
    return texts.cogroup(repeats).applyInArrow(finish(spec, schema), f"doc_id long, {spec.result}")
