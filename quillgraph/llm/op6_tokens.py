r"""Token-id files with a minimal perfect hash index.

A shard is one file: the raw little-endian ids of its documents, each ended by the
end id, in ascending doc_id order; then a footer with the index; then the footer's
length and a magic word. Ids take 2 bytes while the vocabulary fits, else 4. A light pass
over ids and lengths cuts the shards by running bytes, so a reader's memory is bounded by
``SHARD_BYTES`` and the longest document; a table of the cuts stands beside the shards, so
a lookup opens only the shards that may hold its keys. Inside a shard a minimal perfect
hash gives the key's slot in constant time (ranks are stored for each 512 bits); the
slot's fingerprint tells foreign keys, and its row number leads to offset and length.

Spark's text writer makes the files (one row a document, the end id as line
separator), so a shard is committed like any other Spark output: a lost task leaves
nothing behind and is run again. ``binaryFile`` reads them from any store.

Encoding splits a text only where the pre-tokenizer starts a new piece in any case: at
single spaces between characters that cannot be white space, on both sides of a single
line feed between such characters, and between an ASCII letter and a comma or full stop.
Each different chunk goes through the tokenizers library once and its ids are reused.
"""

from __future__ import annotations

import bisect
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .shared import U

#: The id that ends a document.
END_ID = 2
#: Bytes of text in a shard.
SHARD_BYTES = 24 << 20
#: Chunks whose ids a Python worker remembers from block to block, and their bytes at most: under 40 MB in all.
CHUNKS, CHUNK_BYTES = 400_000, 40
#: Leading characters of a text that tell rows of one doc_id apart where shards are cut.
HEAD = 64
#: The table of cuts beside the shards: shard (the number in a file's name), first (its least doc_id).
BOUNDS = "_bounds"

_MAGIC = b"QGTOKS02"


# -- minimal perfect hash -------------------------------------------------------


def build_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Levels of a minimal perfect hash over different 64-bit keys: a key owns the bit that no other key of its level hits."""
    levels, rest = [], keys.astype(np.uint64)
    while len(rest):
        size = -(-2 * len(rest) // 64) * 64
        at = _place(rest, len(levels), size)
        hits = np.bincount(at, minlength=size)
        levels.append(hits == 1)
        rest = rest[hits[at] > 1]
    return levels


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (shared.mix(keys + U((level + 1) * int(shared._C2) % (1 << 64))) % U(size)).astype(np.int64)


_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)
_LINE = 64  # bytes that share a stored rank


class Slots:
    """Levels as packed bits with the number of bits set before each line of 512."""

    def __init__(self, sizes: list[int], packed: list[np.ndarray], ranks: list[np.ndarray]):
        self.sizes, self.packed, self.ranks = sizes, packed, ranks

    @classmethod
    def of(cls, levels: list[np.ndarray]) -> Slots:
        packed, ranks, before = [np.packbits(x) for x in levels], [], 0
        for x in packed:
            sums = np.append(0, np.cumsum(_ONES[x]))
            ranks.append((before + sums[: len(x) : _LINE]).astype(np.uint32))
            before += int(sums[-1])
        return cls([len(x) for x in levels], packed, ranks)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 where no level has a bit for it. A foreign key may get a slot, which its fingerprint betrays."""
        out = np.full(len(keys), -1, dtype=np.int64)
        keys = keys.astype(np.uint64)
        for number, (size, bits, ranks) in enumerate(zip(self.sizes, self.packed, self.ranks, strict=True)):
            open_ = np.flatnonzero(out < 0)
            if not len(open_):
                break
            for part in np.array_split(open_, -(-len(open_) // 65536)):
                at = _place(keys[part], number, size)
                byte, bit = at >> 3, at & 7
                hit = (bits[byte] >> (7 - bit)) & 1 == 1
                part, byte, bit = part[hit], byte[hit], bit[hit]
                line = byte // _LINE
                # At most a line's bytes are counted for a key.
                place = line[:, None] * _LINE + np.arange(_LINE)
                inside = place < byte[:, None]
                whole = (_ONES[bits[np.minimum(place, len(bits) - 1)]] * inside).sum(axis=1)
                out[part] = ranks[line] + whole + _ONES[bits[byte] >> (8 - bit).astype(np.uint8)] if len(part) else 0
        return out


def find_slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    return Slots.of(levels).find(keys)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (shared.mix(keys.astype(np.uint64) ^ shared._C3) >> U(32)).astype(np.uint32)


# -- files ----------------------------------------------------------------------


def footer(keys: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """The index of a shard: keys ascending (a repeated key has several rows), ids of each row."""
    different, first = np.unique(keys, return_index=True)
    index = Slots.of(build_hash(different))
    slots = index.find(different)
    prints, rows = np.zeros(len(different), np.uint32), np.zeros(len(different), np.uint32)
    prints[slots], rows[slots] = fingerprints(different), first
    parts = [struct.pack("<IIII", width, len(keys), len(different), len(index.sizes)), np.array(index.sizes, np.uint32).tobytes()]
    parts += [x.tobytes() for x in (*index.packed, *index.ranks)]
    return b"".join([*parts, prints.tobytes(), rows.tobytes(), keys.astype(np.int64).tobytes(), counts.astype(np.uint32).tobytes()])


class Shard:
    """A shard's bytes (any buffer), read in place."""

    def __init__(self, content, end_id: int):
        content = memoryview(content)
        for width in (2, 4):
            tail = len(content) - width  # the writer's separator after the footer
            if end_id >> (8 * width) == 0 and content[tail - 8 : tail] == _MAGIC and content[tail:] == end_id.to_bytes(width, "little"):
                break
        else:
            raise ValueError("not a token shard with this end id")
        (size,) = struct.unpack("<Q", content[tail - 16 : tail - 8])
        self.data = content
        at = tail - 16 - size
        self.width, self.n, different, deep = struct.unpack_from("<IIII", content, at)
        at += 16

        def take(dtype, count):
            nonlocal at
            x = np.frombuffer(content, dtype=dtype, count=count, offset=at)
            at += x.nbytes
            return x

        sizes = take(np.uint32, deep).tolist()
        packed = [take(np.uint8, s // 8) for s in sizes]
        self.slots = Slots(sizes, packed, [take(np.uint32, -(-len(x) // _LINE)) for x in packed])
        self.prints, self.rows = take(np.uint32, different), take(np.uint32, different)
        self.keys, self.counts = take(np.int64, self.n), take(np.uint32, self.n)
        self.starts = np.cumsum(self.counts, dtype=np.int64) - self.counts

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, or -1."""
        slots = self.slots.find(keys)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == fingerprints(keys[known])
        return np.where(known, self.rows[np.where(known, slots, 0)] if len(self.rows) else -1, -1)

    def ids(self, row: int) -> np.ndarray:
        """The ids of a row as unsigned 32-bit integers."""
        kind = np.dtype(f"<u{self.width}")
        return np.frombuffer(self.data, dtype=kind, count=int(self.counts[row]), offset=int(self.starts[row]) * self.width).astype("<u4")


# -- encoding -------------------------------------------------------------------

_WORKER: dict = {}


class Known:
    """Chunks whose ids are remembered; beyond CHUNKS the half that was met last stays."""

    def __init__(self, width: int):
        self.keys = pa.array([], pa.large_binary())
        self.begin = self.count = self.met = np.zeros(0, np.int64)
        self.ids = np.zeros(0, f"<u{width}")
        self.time = 0

    def add(self, keys: pa.Array, begin: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        self.keys = pa.concat_arrays([self.keys, keys])
        self.begin, self.count = np.concatenate([self.begin, begin + len(self.ids)]), np.concatenate([self.count, count])
        self.ids, self.met = np.concatenate([self.ids, ids]), np.concatenate([self.met, np.zeros(len(keys), np.int64)])

    def touch(self, at: np.ndarray) -> None:
        self.time += 1
        self.met[at] = self.time
        if len(self.met) > CHUNKS:
            short = np.flatnonzero(pc.binary_length(self.keys).to_numpy() <= CHUNK_BYTES)
            keep = np.sort(short[np.argsort(-self.met[short], kind="stable")[: CHUNKS // 2]])
            self.keys, self.met = self.keys.take(pa.array(keep)), self.met[keep]
            self.ids = self.ids[_ranges(self.begin[keep], self.count[keep])]
            self.count = self.count[keep]
            self.begin = np.cumsum(self.count) - self.count


def _tokenizer(path: str, width: int):
    if _WORKER.get("path") != (path, width):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        # In a byte-level vocabulary a token has a character for each byte it stands for.
        sizes = np.zeros(tokenizer.get_vocab_size(), dtype=np.int64)
        for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
            sizes[i] = len(token)
        for i, token in tokenizer.get_added_tokens_decoder().items():
            sizes[i] = len(token.content.encode())
        _WORKER.update(path=(path, width), tokenizer=tokenizer, sizes=sizes, known=Known(width))
    return _WORKER["known"]


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after another."""
    reach = np.cumsum(count)
    return np.repeat(begin - (reach - count), count) + np.arange(int(reach[-1]) if len(reach) else 0)


def _bytes_of(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat, offsets = shared.text_array(chunks)
    return flat, offsets.astype(np.int64)


def _learn(chunks: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of the chunks (none empty): where each begins in the ids returned, how many it has, and the ids.

    Chunks that may follow each other (spaced ones as they are, others around a line feed) are
    encoded many at a time; the tokens' sizes say where each ends. Where a token crosses an
    end, and for other chunks, each is encoded by itself.
    """
    tokenizer, sizes = _WORKER["tokenizer"], _WORKER["sizes"]
    kind = np.dtype(f"<u{width}")
    flat, offsets = _bytes_of(chunks)
    size, last = np.diff(offsets), offsets[1:] - 1
    spaced = flat[offsets[:-1]] == 0x20
    head = offsets[:-1] + spaced
    starts_well = (size > spaced) & (_VISIBLE | _LEAD)[flat[np.minimum(head, last)]]
    ends_well = _VISIBLE[flat[last]] | ((flat[last] >= 0x80) & (size > 1) & _LEAD[flat[np.maximum(last - 1, 0)]])
    begin, count = np.zeros(len(size), np.int64), np.full(len(size), -1, np.int64)
    out, have = [], 0
    for which, gap in ((np.flatnonzero(starts_well & ends_well & spaced), 0), (np.flatnonzero(starts_well & ends_well & ~spaced), 1)):
        for at in range(0, len(which), 60000):
            some = which[at : at + 60000]
            # The chunks' bytes side by side, a line feed after each where there is a gap.
            own = size[some] + gap
            text = flat[np.minimum(_ranges(offsets[some], own), len(flat) - 1)]
            reach = np.append(0, np.cumsum(own))
            if gap:
                text[reach[1:] - 1] = 0x0A
            raw, edges = text.tobytes(), np.append(np.arange(0, len(some), 200), len(some))
            parts = [raw[reach[i] : reach[j] - gap].decode() for i, j in zip(edges[:-1], edges[1:], strict=True)]
            for i, j, got in zip(edges[:-1].tolist(), edges[1:].tolist(), tokenizer.encode_batch_fast(parts, add_special_tokens=False), strict=True):
                ids = np.array(got.ids, dtype=kind)
                upto = np.append(0, np.cumsum(sizes[ids]))
                start = reach[i:j] - reach[i]
                end = start + size[some[i:j]]
                a, z = np.searchsorted(upto, start), np.searchsorted(upto, end)
                fits = (upto[np.minimum(a, len(ids))] == start) & (upto[np.minimum(z, len(ids))] == end)
                begin[some[i:j]] = have + a
                count[some[i:j]] = np.where(fits, z - a, -1)
                out.append(ids)
                have += len(ids)
    alone = np.flatnonzero(count < 0)
    for i, got in zip(alone.tolist(), tokenizer.encode_batch_fast([x.decode() for x in chunks.take(pa.array(alone)).to_pylist()], add_special_tokens=False), strict=True):
        begin[i], count[i] = have, len(got.ids)
        out.append(np.array(got.ids, dtype=kind))
        have += len(got.ids)
    return begin, count, np.concatenate(out) if out else np.zeros(0, kind)


#: Characters that are no white space: visible ASCII, and what two UTF-8 bytes write from U+00C0 on.
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True
_LEAD = np.zeros(256, dtype=bool)
_LEAD[0xC3:0xE0] = True


_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True


def chunk_starts(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the texts may be cut (see above): their starts, and places inside them."""
    n = len(flat)
    place = np.flatnonzero((flat == 0x20) | (flat == 0x0A))
    place = place[(place >= 2) & (place < n - 1)]
    before, lead, after = flat[place - 1], flat[place - 2], flat[place + 1]
    place = place[(_VISIBLE[before] | ((before >= 0x80) & _LEAD[lead])) & (_VISIBLE[after] | _LEAD[after])]
    row = np.searchsorted(offsets, place, "right") - 1
    # Both neighbours are of the same text.
    place = place[(place - 2 >= offsets[row]) & (place + 1 < offsets[row + 1])]
    cut = np.zeros(n + 1, dtype=bool)
    cut[place] = True
    cut[place[flat[place] == 0x0A] + 1] = True
    mark = np.flatnonzero((flat == 0x2C) | (flat == 0x2E))
    mark = mark[mark >= 1]
    cut[mark[_ASCII_LETTER[flat[mark - 1]]]] = True  # across texts too, where a cut is anyway
    cut[offsets[:-1]] = True
    return np.flatnonzero(cut[:n])


def encode(flat: np.ndarray, offsets: np.ndarray, path: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, and the number of each."""
    known = _tokenizer(path, width)
    starts = chunk_starts(flat, offsets)
    if not len(starts):
        return np.zeros(0, f"<u{width}"), np.zeros(len(offsets) - 1, np.int64)
    ends = np.append(starts, len(flat)).astype(np.int64)
    chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
    different = chunks.dictionary
    at = pc.index_in(different, value_set=known.keys)
    missing = at.null_count
    begin, count, ids = known.begin, known.count, known.ids
    if missing:
        new = different.filter(pc.is_null(at))
        b, c, more = _learn(new, width)
        begin, count, ids = np.concatenate([begin, b + len(ids)]), np.concatenate([count, c]), np.concatenate([ids, more])
        at = at.to_numpy(zero_copy_only=False)
        here = np.isnan(at)
        at[here] = len(known.keys) + np.arange(missing)
        known.add(new, b, c, more)
    at = np.asarray(at).astype(np.int64)
    known.touch(at)
    which = at[chunks.indices.to_numpy()]
    took = count[which]
    out = ids[_ranges(begin[which], took)]
    reach = np.cumsum(took)
    upto = np.append(0, reach)[np.searchsorted(starts, offsets)]
    return out, np.diff(upto)


def _write(path: str, width: int, end: bytes):
    def run(batches) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for b in shared.blocks(batches, most=2 << 20):
            flat, offsets = shared.text_array(b.column("text"))
            ids, n = encode(flat, offsets, path, width)
            raw, edge = ids.tobytes(), np.append(0, np.cumsum(n)) * width
            keys += [shared.NULL_ID if k is None else k for k in b.column("doc_id").to_pylist()]
            counts += (n + 1).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([raw[a:z] for a, z in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], ["value"])
        if keys:
            # The writer ends the last document before the footer, and the footer too.
            index = footer(np.array(keys, np.int64), np.array(counts, np.int64), width)
            yield pa.RecordBatch.from_arrays([pa.array([index + struct.pack("<Q", len(index)) + _MAGIC], pa.binary())], ["value"])
        pa.default_memory_pool().release_unused()

    return run


# -- shards ---------------------------------------------------------------------


def _cuts(shard_bytes: int):
    """The keys (uid, head) at which a partition's rows, in order, begin a shard."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        have = None
        for b in batches:
            total = np.cumsum(b.column("n").to_numpy())
            at, cuts, before = 0, [], 0
            while at < len(total):
                if have is None or (have and have + total[at] - before > shard_bytes):
                    cuts.append(at)
                    have = 0
                # The rows from here that still fit; the first of a shard always does.
                to = max(at + (have == 0), int(np.searchsorted(total, before + shard_bytes - have, "right")))
                if to > at:
                    have += int(total[to - 1]) - before
                    at, before = to, int(total[to - 1])
            if cuts:
                yield b.take(pa.array(cuts)).select(["uid", "head"])

    return run


def _shard_of(sent):
    """The number of the shard that a key belongs to: the last one that begins at it or before."""

    @F.arrow_udf("int")
    def of(uid: pa.Array, head: pa.Array) -> pa.Array:
        ids, heads = sent.value
        uid = uid.to_numpy()
        low, high = np.searchsorted(ids, uid, "left"), np.searchsorted(ids, uid, "right")
        out = high
        for i in np.flatnonzero(low < high).tolist():  # ids at which a shard begins
            out[i] = bisect.bisect_right(heads, head[i].as_py().encode(), int(low[i]), int(high[i]))
        return pa.array(np.maximum(out - 1, 0).astype(np.int32))

    return of


def write_tokens(docs: DataFrame, out: str, tokenizer_file: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every whole text and write the shards under ``out``.

    Input: doc_id, text; other columns are ignored. A null text is empty; a null doc_id
    comes first; rows with one doc_id stand side by side in the order of their texts, in
    several shards where they are many (rows that share also the text's first HEAD characters
    stay together). No rows write no shards. A text is encoded as one string, whatever its
    length: a worker holds some ten times its bytes.
    """
    spark = docs.sparkSession
    shared.ready(spark)
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer_file).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    if not 0 <= end_id < 1 << 31:
        raise ValueError("end_id must be from 0 to 2**31 - 1")
    end = int(end_id).to_bytes(width, "little")
    # The text writer spells its separator in UTF-8, so each byte of the end id must be one such character.
    if max(end) > 0x7F:
        raise ValueError("the bytes of end_id must be below 128")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = F.coalesce("doc_id", F.lit(shared.NULL_ID)).alias("uid"), F.substring(F.coalesce("text", F.lit("")), 1, HEAD).alias("head")
    light = rows.select(*key, (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("n"))
    parts = shared.buckets(shared.text_bytes(docs), 8 * shard_bytes, 1)
    cuts = light.repartitionByRange(parts, "uid", "head").sortWithinPartitions("uid", "head").mapInArrow(_cuts(shard_bytes), "uid long, head string")
    # Some 100 bytes a shard.
    bounds = sorted({(r["uid"], r["head"].encode()) for r in cuts.collect()})
    if not bounds:
        rows.select(F.col("text").alias("value")).limit(0).write.text(out)
        return
    sent = spark.sparkContext.broadcast((np.array([u for u, _ in bounds], np.int64), [h for _, h in bounds]))
    rows = rows.withColumn("shard", _shard_of(sent)(*key)).repartitionById(len(bounds), F.col("shard")).drop("shard").sortWithinPartitions("doc_id", "text")
    raw = rows.mapInArrow(_write(tokenizer_file, width, end), "value binary")
    raw.select(F.col("value").cast("string")).write.option("lineSep", end.decode()).option("compression", "none").text(out)
    spark.createDataFrame([(i, u) for i, (u, _) in enumerate(bounds)], "shard int, first long").coalesce(1).write.parquet(f"{out}/{BOUNDS}")


def _scan(end_id: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                shard = Shard(content.as_buffer(), end_id)
                at = shard.find(shard.keys)
                # Rows that repeat a key follow its first one.
                at = at + (np.arange(shard.n) - np.searchsorted(shard.keys, shard.keys))
                crc = [zlib.crc32(shard.ids(i)) for i in at.tolist()]
                keys = shard.keys.tolist()
                yield pa.RecordBatch.from_arrays([pa.array([name] * shard.n), pa.array([None if k == shared.NULL_ID else k for k in keys], pa.int64()), pa.array(shard.starts[at]), pa.array(shard.counts[at].astype(np.int64)), pa.array(crc, pa.int64())], ["path", "doc_id", "start", "n_tokens", "ids_crc32"])
        pa.default_memory_pool().release_unused()

    return run


def _files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(list(paths))


def read_tokens(spark: SparkSession, out: str, end_id: int = END_ID) -> DataFrame:
    """One row a document, read through the shards' indexes: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    Only one row a shard is gathered in one place, for the sums of ids before each. A folder without shards gives no rows.
    """
    shared.ready(spark)
    rows = _files(spark, out).where("length > 0").select("path", "content").mapInArrow(_scan(end_id), "path string, doc_id long, start long, n_tokens long, ids_crc32 long").checkpoint()
    totals = {r["path"]: r["n"] for r in rows.groupBy("path").agg(F.sum("n_tokens").alias("n")).collect()}
    before, sums = 0, []
    for p in sorted(totals):
        sums.append((p, before))
        before += totals[p]
    if not sums:
        return rows.drop("path")
    bases = spark.createDataFrame(sums, "path string, base long")
    return rows.join(bases, "path").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def shards_of(spark: SparkSession, out: str, keys: list[int]) -> list[str]:
    """The files that may hold some of the keys, from the table of cuts and the files' names; no shard is opened."""
    bounds = sorted((r["first"], r["shard"]) for r in spark.read.parquet(f"{out}/{BOUNDS}").collect())
    first = [u for u, _ in bounds]
    wanted = set()
    for k in keys:
        # A key may begin in the shard before the first one that begins at it.
        wanted.update(bounds[i][1] for i in range(max(0, bisect.bisect_left(first, k) - 1), bisect.bisect_right(first, k)))
    names = [r["path"] for r in _files(spark, out).where("length > 0").select("path").collect()]
    return sorted(p for p in names if int(p.rsplit("/", 1)[1].split("-")[1]) in wanted)


def fetch_ids(spark: SparkSession, out: str, keys: list[int], end_id: int = END_ID) -> DataFrame:
    """The ids of the given keys (a stated list): doc_id, ids. Absent keys give no rows; a repeated key gives a row for each of its documents."""
    shared.ready(spark)
    wanted = np.unique(np.array(keys, dtype=np.int64))
    schema = "doc_id long, ids array<long>"
    paths = shards_of(spark, out, wanted.tolist()) if len(wanted) else []
    if not paths:
        return spark.createDataFrame([], schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                shard = Shard(content.as_buffer(), end_id)
                mine = wanted[(wanted >= shard.keys[0]) & (wanted <= shard.keys[-1])]
                found = []
                for key, row in zip(mine.tolist(), shard.find(mine).tolist(), strict=True):
                    while 0 <= row < shard.n and shard.keys[row] == key:
                        found.append((key, shard.ids(row).tolist()))
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return _files(spark, *paths).select("content").mapInArrow(run, schema)


def token_rows(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID, out: str | None = None) -> DataFrame:
    """Write the files, read them back, and return read_tokens' rows; without ``out`` the files go to a folder that is removed."""
    spark = docs.sparkSession
    folder = out or shared.scratch(spark, "tokens")
    write_tokens(docs, folder, tokenizer_file, end_id)
    rows = read_tokens(spark, folder, end_id)
    if not out:
        shared.remove(spark, folder)
    return rows
