"""Helpers that several training-data operators use: tables, checkpoints, Arrow text buffers, hashes."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a null doc_id counts as in every ordering: smaller than any other id.
NULL_ID = -(2**63)

U = np.uint64
_C1, _C2, _C3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = []
LONG_SPAN = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, and see that checkpoints have a home that all executors share.

    The cluster names it in spark.checkpoint.dir. Only where driver and executors are one process
    does a temporary folder do; elsewhere a missing setting is an error.
    """
    if not spark.conf.get("spark.checkpoint.dir", "") and spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillgraph-"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ready(spark)
    home = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    return f"{home.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Have the driver collect its garbage: the shuffles of finished rounds are removed, and its heap, grown by the planning of many small queries, shrinks."""
    spark.sparkContext._jvm.System.gc()


def written(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows from a table written in the shared folder, and its place, to be removed when nothing reads it."""
    folder = scratch(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder), folder


def fresh(name: str, taken) -> str:
    """The name, lengthened until no column is called so (names differ by more than case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Total bytes of the text column; one narrow scan that sizes every later bucketing."""
    row = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long")).alias("n")).first()
    return int(row["n"] or 0)


def buckets(total_bytes: int, each: int = 16 << 20, least: int = 4) -> int:
    """Buckets that keep about ``each`` bytes of text together, however large the input is."""
    return max(least, -(-total_bytes // each))


def spread(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """rows dealt by key to ``parts`` partitions, if the session's shuffles have fewer: tasks then do not grow with the input."""
    return rows.repartition(parts, key) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def text_array(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, nulls as empty, and the row offsets in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return flat, ends - ends[0]


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text, or a single row if that alone is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, total = 0, np.cumsum(sizes)
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> U(32))) * _C3
    h = (h ^ (h >> U(29))) * _C1
    return h ^ (h >> U(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.ones(size, dtype=np.uint64)
            have, step = 1, base
            while have < size:
                p[have : 2 * have] = p[:have] * U(step)
                step, have = step * step % (1 << 64), 2 * have
            out.append(p)
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they stand.

    A polynomial with a random value for each byte; spans over LONG_SPAN bytes, for which
    polynomials modulo 2 ** 64 can be made to collide, are hashed by BLAKE2b.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[flat] * up[: len(flat)], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _C2)
    long = np.flatnonzero(ends - starts > LONG_SPAN)
    if len(long):
        raw = memoryview(np.ascontiguousarray(flat))
        out[long] = np.frombuffer(b"".join(hashlib.blake2b(raw[a:z], digest_size=8).digest() for a, z in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64)
    return out


def word_spans(flat: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, which never cross rows; and the row offsets among the words."""
    inside = is_word[flat]
    before = np.empty(len(flat), dtype=bool)
    if len(flat):
        before[0] = False
        before[1:] = inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(flat)]
        before[heads] = False
        after = np.empty(len(flat), dtype=bool)
        after[-1] = False
        after[:-1] = inside[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        after[tails] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, offsets)


def gram_levels(base: np.ndarray, top: int) -> list[np.ndarray]:
    """Hashes of the runs of 1, 2, 4, ... 2**top units that start at each place."""
    out, size = [base], 1
    for _ in range(top):
        h = out[-1]
        if len(h) <= size:
            out.append(np.zeros(0, np.uint64))
            continue
        tail = h[size:]
        h = h[:-size] * _C1 + (tail ^ (tail >> U(29))) * _C2
        out.append(h ^ (h >> U(32)))
        size *= 2
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbouring values."""
    if len(values) < width:
        return values[:0]
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def lower_ascii() -> np.ndarray:
    """A byte map that lower-cases A-Z alone."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


#: Fixed byte classes of the contracts: words are runs of anything but space and \\x09-\\x0D ...
SPACED_WORD = np.ones(256, dtype=bool)
SPACED_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: ... or runs of digits, lower-case letters and everything outside ASCII.
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True
