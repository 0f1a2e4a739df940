"""Semantic retrieval: vector checks, exact cosine pools, strengths, coverage and validity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.policy import Retrieval

#: Units of a task's block at most; units that are compared at a time; numbers of a matrix of exact cosines.
BLOCK, UNITS, CELLS = 65_536, 2_048, 4_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def vector_status(v: Column, dimensions: int, normalized: bool) -> Column:
    """ok, or why a vector (array of doubles) cannot be used."""
    length = norm(v)
    return (
        F.when(v.isNull() | (F.size(v) != dimensions), "dimensions")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), "not-finite")
        .when(length <= 1e-12, "zero")
        .when(F.lit(normalized) & (F.abs(length - 1) > 0.03), "not-normalized")
        .otherwise("ok")
    )


def unit_vectors(units: DataFrame, dimensions: int, normalized: bool = True) -> DataFrame:
    """The usable units with vectors of length 1."""
    v = F.transform("vector", lambda x: x.cast("double"))
    fine = units.withColumn("vector", v).where(vector_status(F.col("vector"), dimensions, normalized) == "ok")
    return fine.withColumn("_n", norm(F.col("vector"))).withColumn("vector", F.transform("vector", lambda x: x / F.col("_n"))).drop("_n")


def valid_units(units: DataFrame, live: DataFrame) -> DataFrame:
    """Only units of their documents' current revisions."""
    return units.join(live.select("doc", "revision"), ["doc", "revision"], "left_semi")


@dataclass
class _Side:
    """Documents of some units, these in layers: the first unit of each document, the second, and so on, documents with more units first."""

    name: pa.Array
    start: np.ndarray
    size: np.ndarray
    section: np.ndarray
    vector: np.ndarray
    kind: np.ndarray
    layered: np.ndarray
    layers: list[int]


def _side(table: pa.Table, kinds: dict[bytes, int]) -> _Side:
    """table: doc, section, vector, ordered by doc and unit; documents of the same vectors and sections are of one kind."""
    doc, count = table.column("doc").combine_chunks(), len(table)
    section = table.column("section").combine_chunks().dictionary_encode()
    vector = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(count, -1)
    start = np.flatnonzero(np.append(True, pc.not_equal(doc[1:], doc[:-1]).to_numpy(zero_copy_only=False)))
    size = np.diff(np.append(start, count))
    by = np.argsort(-size, kind="stable")
    start, size = start[by], size[by]
    layers = [int(np.searchsorted(-size, -p, "left")) for p in range(int(size[0]))]
    rows = np.concatenate([start[:n] + p for p, n in enumerate(layers)])
    names = section.dictionary.to_pylist()
    codes = section.indices.fill_null(len(names)).to_numpy()
    shown = np.array([hash(x) for x in [*names, None]], dtype=np.int64)[codes]
    content = [hashlib.blake2b(vector[a : a + n].tobytes() + shown[a : a + n].tobytes(), digest_size=16).digest() for a, n in zip(start.tolist(), size.tolist(), strict=True)]
    kind = np.array([kinds.setdefault(c, len(kinds)) for c in content], dtype=np.int64)
    return _Side(doc.take(pa.array(start)), start, size, codes, vector, kind, vector[rows].astype(np.float32), layers)


def _folded(cells: np.ndarray, layers: list[int]) -> np.ndarray:
    """The largest of the layers, which lie one after another along the first axis."""
    out, at = cells[: layers[0]], layers[0]
    for n in layers[1:]:
        np.maximum(out[:n], cells[at : at + n], out=out[:n])
        at += n
    return out


def _similar(a: _Side, i: np.ndarray, b: _Side, j: np.ndarray, matches: int | None) -> np.ndarray:
    """The similarity of documents i of a and j of b in double precision: a pair's value depends on its vectors only."""
    out = np.empty(len(i))
    shape = a.size[i] << 32 | b.size[j]
    for s in np.unique(shape):
        of, left, right = np.flatnonzero(shape == s), int(s) >> 32, int(s) & 0xFFFFFFFF
        step = max(1, CELLS // (left * right + 64 * (left + right)))
        for part in (of[k : k + step] for k in range(0, len(of), step)):
            x, y = a.start[i[part], None] + np.arange(left), b.start[j[part], None] + np.arange(right)
            cos = np.clip(np.einsum("pld,prd->plr", a.vector[x], b.vector[y]), -1, 1)
            out[part] = cos.max(axis=(1, 2)) if matches is None else _greedy(cos, a.section[x], b.section[y], matches)
    return out


def _greedy(cos: np.ndarray, left: np.ndarray, right: np.ndarray, matches: int) -> np.ndarray:
    """The mean of the best matches of each pair of documents, each with a new section on both sides; of equal ones the first unit's."""
    pair, width = np.arange(len(cos)), cos.shape[2]
    total, taken = np.zeros(len(cos)), np.zeros(len(cos))
    for _ in range(matches):
        flat = cos.reshape(len(cos), -1)
        at = flat.argmax(axis=1)
        best = flat[pair, at]
        some = np.isfinite(best)
        total += np.where(some, best, 0)
        taken += some
        used = (left == left[pair, at // width][:, None])[:, :, None] | (right == right[pair, at % width][:, None])[:, None, :]
        cos = np.where(used, -np.inf, cos)
    return total / taken


def _chunks(batches: Iterator[pa.RecordBatch], units: int) -> Iterator[pa.Table]:
    """Tables of whole documents of one side, of ``units`` rows or more but for the last."""
    held: list[pa.Table] = []
    for b in batches:
        new = pa.Table.from_batches([b])
        sides = new.column("_side").to_numpy()
        if held and held[-1].column("_side")[-1].as_py() != sides[0]:
            yield pa.concat_tables(held)
            held = []
        turn = int(np.searchsorted(sides, 1))
        for part in (new[:turn], new[turn:]) if 0 < turn < len(new) else (new,):
            if held and held[-1].column("_side")[-1] != part.column("_side")[0]:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
            if sum(map(len, held)) > units and part.column("_side")[0].as_py():
                whole = pa.concat_tables(held)
                same = pc.equal(whole.column("doc"), whole.column("doc")[-1]).combine_chunks()
                cut = len(whole) - same.true_count
                if cut:
                    yield whole[:cut]
                held = [whole[cut:]]
    if held:
        yield pa.concat_tables(held)


def _pools(matches: int | None, budget: int):
    """Pools of the documents of a block (_side 0, first), against all documents (_side 1) in order of their names, some at a time.

    Cosines in single precision rule pairs out: what is below a center's least kept similarity by
    more than their error. A mean of matches is no larger than the best one. The rest is computed
    in double precision, once for documents of one kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers: list[tuple[_Side, np.ndarray, np.ndarray, np.ndarray]] = []
        kinds: dict[bytes, int] = {}
        own: list[pa.Table] = []
        names: list[pa.Array] = []
        seen = lasting = 0
        for table in _chunks(batches, UNITS):
            if not table.column("_side")[0].as_py():
                own.append(table)
                continue
            if own:
                for part in _chunks(iter([b for t in own for b in t.set_column(t.column_names.index("_side"), "_side", pa.array(np.ones(len(t), np.int32))).combine_chunks().to_batches(max_chunksize=UNITS)]), UNITS):
                    a = _side(part, kinds)
                    n = len(a.start)
                    centers.append((a, np.full((n, budget), -np.inf), np.full((n, budget), -1), np.full(n, -np.inf)))
                own, lasting = [], len(kinds)
            if not centers:
                continue
            b = _side(table, kinds)
            number = np.argsort(np.argsort(b.start)) + seen
            names.append(b.name.take(pa.array(np.argsort(b.start))))
            error = np.float32(max(1e-5, 4e-7 * b.vector.shape[1]))
            for a, sims, ids, floor in centers:
                cells = _folded(_folded(a.layered @ b.layered.T, a.layers).T, b.layers).T
                i, j = np.nonzero(cells >= (floor - error)[:, None])
                fresh = pc.not_equal(a.name.take(pa.array(i)), b.name.take(pa.array(j))).to_numpy(zero_copy_only=False)
                i, j = i[fresh], j[fresh]
                if not len(i):
                    continue
                _, first, again = np.unique(a.kind[i] << 32 | b.kind[j], return_index=True, return_inverse=True)
                similarity = _similar(a, i[first], b, j[first], matches)[again]
                # Later names lose ties.
                better = similarity > floor[i]
                i, j, similarity = i[better], j[better], similarity[better]
                rows, at = np.unique(i, return_inverse=True)
                k = np.concatenate([np.repeat(np.arange(len(rows)), budget), at])
                s, d = np.concatenate([sims[rows].ravel(), similarity]), np.concatenate([ids[rows].ravel(), number[j]])
                by = np.lexsort((d, -s, k))
                k, s, d = k[by], s[by], d[by]
                place = np.arange(len(k)) - np.searchsorted(k, k)
                keep = place < budget
                sims[rows[k[keep]], place[keep]], ids[rows[k[keep]], place[keep]] = s[keep], d[keep]
                floor[rows] = sims[rows, -1]
            seen += len(b.start)
            for c in list(kinds)[lasting:]:
                del kinds[c]
        for a, sims, ids, _ in centers:
            i, place = np.nonzero(ids >= 0)
            every = names[0] if len(names) == 1 else pa.concat_arrays(names)
            names = [every]
            arrays = a.name.take(pa.array(i)), every.take(pa.array(ids[i, place])), pa.array(sims[i, place]), pa.array(place + 1, pa.int32())
            yield pa.RecordBatch.from_arrays([x.cast(pa.string()) if pa.types.is_large_string(x.type) else x for x in arrays], ["center", "neighbor", "similarity", "rank"])

    return run


def _tasks(spark, n: int, block: int) -> int:
    """Blocks for n units: of no more than ``block``, and some for each core where there is work for them."""
    return max(1, -(-n // block), min(2 * spark.sparkContext.defaultParallelism, -(-n // UNITS)))


def semantic_pool(units: DataFrame, retrieval: Retrieval = Retrieval(), block: int = BLOCK) -> DataFrame:
    """(center, neighbor, similarity, rank, pool_size): the most similar documents of every document, by exact cosine.

    units: unit, doc, section, vector (length 1). Documents are dealt to blocks, a task each, to which
    all units are sent in order: a task holds its block, the budget of its centers, and some units at a
    time. There are twice as many blocks as cores, more only where a block would pass its size, so
    what is shuffled grows with the units. The pool's size is the number of other documents with units.
    """
    n, total = units.agg(F.count("*"), F.countDistinct("doc")).first()
    blocks = _tasks(units.sparkSession, n, block)
    home = F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int")
    sent = F.concat(F.array(F.struct(home.alias("to"), F.lit(0).alias("side"))), F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: F.struct(x.alias("to"), F.lit(1).alias("side"))))
    dealt = units.select("unit", "doc", "section", "vector", F.explode(sent).alias("_s")).select("unit", "doc", "section", "vector", F.col("_s.to").alias("_to"), F.col("_s.side").alias("_side"))
    ordered = dealt.repartitionById(blocks, F.col("_to")).sortWithinPartitions("_side", "doc", "unit").select("_side", "doc", "section", "vector")
    matches = None if retrieval.aggregation == "max" else retrieval.top_matches
    met = ordered.mapInArrow(_pools(matches, retrieval.budget), "center string, neighbor string, similarity double, rank int")
    return met.withColumn("pool_size", F.lit(total - 1).cast("long"))


def _cosines(least: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Asked units (_side 0, first) are held, the others pass by."""
        asked: list[tuple[pa.Array, np.ndarray]] = []
        for b in batches:
            sides = b.column("_side").to_numpy()
            turn = int(np.searchsorted(sides, 1))
            for part, held in ((b[:turn], True), (b[turn:], False)):
                for at in range(0, len(part), UNITS):
                    some = part[at : at + UNITS]
                    name, v = some.column("unit"), some.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1)
                    if held:
                        asked.append((name, v.copy()))
                        continue
                    for own, w in asked:
                        cos = w @ v.T
                        i, j = np.nonzero(cos >= least) if least is not None else np.indices(cos.shape).reshape(2, -1)
                        out = pa.RecordBatch.from_arrays([own.take(pa.array(i)), name.take(pa.array(j)), pa.array(cos[i, j])], ["unit_a", "unit_b", "cosine"])
                        yield out.filter(pc.not_equal(out.column("unit_a"), out.column("unit_b")))

    return run


def asked_cosines(asked: DataFrame, units: DataFrame, block: int = BLOCK, least: float | None = None) -> DataFrame:
    """(unit_a, unit_b, cosine) of each asked unit with every other unit, from ``least`` on; both: unit, vector (length 1).

    Both sides are dealt to blocks, and every two blocks meet in a task: nothing is broadcast, and
    a task holds a block of asked units, past which the others go. The work is asked times units.
    """
    n, m = asked.count(), units.count()
    here, there = max(1, -(-n // block)), _tasks(units.sparkSession, m, block)
    dealt = lambda n: F.pmod(F.xxhash64("unit"), F.lit(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = asked.select("unit", "vector", F.lit(0).alias("_side"), dealt(here).alias("_i"), all_(there).alias("_j"))
    b = units.select("unit", "vector", F.lit(1).alias("_side"), dealt(there).alias("_j"), all_(here).alias("_i")).select(*a.columns)
    met = a.union(b).repartitionById(here * there, F.col("_i") * there + F.col("_j")).sortWithinPartitions("_side").select("_side", "unit", "vector")
    return met.mapInArrow(_cosines(least), "unit_a string, unit_b string, cosine double")


def strength(similarity: Column, modality: Column | str, retrieval: Retrieval = Retrieval()) -> Column:
    """A cosine mapped to 0..1 by its modality's range."""
    kind = F.lit(modality) if isinstance(modality, str) else modality
    out = F.lit(0.0)
    for name, (low, high) in retrieval.mappings.items():
        out = F.when(kind == name, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (similarity - low) / F.lit(high - low)))).otherwise(out)
    return out


def modality(a: Column, b: Column) -> Column:
    image = F.lit("image-context")
    return F.when((a == image) & (b == image), "image-image").when((a == image) | (b == image), "text-image").otherwise("text-text")


def reuse_split(old: DataFrame, new: DataFrame) -> DataFrame:
    """new units (doc, unit, content_hash) with action reuse where the document already holds that content, else encode."""
    known = old.select("doc", "content_hash").distinct().withColumn("_known", F.lit(True))
    return new.join(known, ["doc", "content_hash"], "left").withColumn("action", F.when(F.col("_known"), "reuse").otherwise("encode")).drop("_known")


def current_results(results: DataFrame, live: DataFrame) -> DataFrame:
    """Late results marked: accepted only at the live revision and the latest sequence of their document."""
    latest = results.groupBy("doc").agg(F.max("sequence").alias("_latest"))
    joined = results.join(latest, "doc").join(live.select("doc", F.col("revision").alias("_live")), "doc", "left")
    return joined.withColumn("accepted", F.coalesce((F.col("revision") == F.col("_live")) & (F.col("sequence") == F.col("_latest")), F.lit(False))).drop("_latest", "_live")


def document_status(documents: DataFrame, indexed: DataFrame) -> DataFrame:
    """doc, revision, status: pending without an entry, stale at another revision, else the entry's status."""
    joined = documents.join(indexed.select("doc", F.col("revision").alias("_r"), F.col("status").alias("_s"), "units", "ready"), "doc", "left")
    status = F.when(F.col("_s").isNull(), "pending").when(F.col("_r") != F.col("revision"), "stale").otherwise(F.col("_s"))
    return joined.select("doc", "revision", status.alias("status"), F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("ready", F.lit(0)).alias("ready"))


def coverage(status: DataFrame) -> DataFrame:
    """One row: documents, units, ready, status. An empty corpus is ready."""
    any_ = lambda s: F.coalesce(F.max(F.col("status") == s), F.lit(False))
    ready = F.coalesce(F.sum("ready"), F.lit(0))
    whole = F.coalesce(F.min(F.col("status") == "ready"), F.lit(True))
    overall = F.when(whole, "ready").when(ready > 0, "partial").when(any_("stale"), "stale")
    for s in ("error", "cancelled", "limit-exceeded", "unsupported"):
        overall = overall.when(any_(s), s)
    return status.agg(F.count("*").alias("documents"), F.coalesce(F.sum("units"), F.lit(0)).alias("units"), ready.alias("ready"), overall.otherwise("pending").alias("status"))


def pair_state(pairs: DataFrame, status: DataFrame, space: str | None) -> DataFrame:
    """pairs (node_a, node_b) with state: not-configured without a space, pending, stale, the first other status that is not ready, or not-recalled.

    status: document_status of all documents.
    """
    if space is None:
        return pairs.withColumn("state", F.lit("not-configured"))
    a, b = status.select(F.col("doc").alias("node_a"), F.col("status").alias("_a")), status.select(F.col("doc").alias("node_b"), F.col("status").alias("_b"))
    joined = pairs.join(a, "node_a", "left").join(b, "node_b", "left")
    one = lambda s: (F.col("_a") == s) | (F.col("_b") == s)
    absent = F.col("_a").isNull() | F.col("_b").isNull()
    state = F.when(absent, "pending").when(one("pending"), "pending").when(one("stale"), "stale").when(F.col("_a") != "ready", F.col("_a")).when(F.col("_b") != "ready", F.col("_b")).otherwise("not-recalled")
    return joined.withColumn("state", state).drop("_a", "_b")


def signals_valid(signals: DataFrame, units: DataFrame, space: str) -> DataFrame:
    """signals (signal, space, unit, content_hash: a row for each contributing unit), one row a signal: valid if all units are unchanged in the space."""
    live = units.select("unit", F.col("content_hash").alias("_h"))
    joined = signals.join(live, "unit", "left")
    fine = (F.col("space") == space) & F.coalesce(F.col("_h") == F.col("content_hash"), F.lit(False))
    return joined.groupBy("signal").agg(F.bool_and(fine).alias("valid"))
