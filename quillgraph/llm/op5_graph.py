"""Approximate nearest neighbours by a robust-pruned directed graph.

Vectors are dealt over shards; equal vectors of a shard are one node. A shard's graph is
built in batches that double in size: greedy searches on the graph so far propose a
node's neighbours, and pruning with a relaxed distance keeps diverse ones: a candidate
goes if a kept neighbour is nearer to it, by the factor ALPHA, than the node is. Back
edges are added and pruned alike. Every query then runs a beam search in each shard, and
the best of all shards are ranked by the exact inner product in double precision.

Inner products become distances by one more coordinate, which brings all vectors of a
shard to one length. That coordinate misleads a search where lengths differ much, so shards
hold a band of lengths each, and are cut further by a hash of the id. Searches of a batch
advance together, vectorised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

#: Most edges of a node, beam of the building and of the querying search, and the relaxation of pruning.
DEGREE, BUILD_BEAM, BEAM, ALPHA = 32, 48, 160, 1.2
#: Vectors of a shard, and queries sent to all shards at once.
SHARD, QUERIES = 8_000, 20_000
#: Longest by shortest vector of a band; bands at most, the last of which holds all shorter vectors.
BAND, BANDS = 1.1, 96


def _distances(x: np.ndarray, nodes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of each row of nodes to its own query, up to a constant of the query."""
    return (x[nodes] @ q[:, :, None])[:, :, 0]


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The beam nearest nodes found for each query, nearest first, -1 where fewer; and their distances.

    x: vectors with the last column their halved squared length, negated; q has 1 there; so a
    smaller distance is a larger product.
    """
    n, m = len(x), len(q)
    nodes = np.full((m, beam), -1, dtype=np.int64)
    dist = np.full((m, beam), np.inf, dtype=np.float32)
    done = np.ones((m, beam), dtype=bool)
    nodes[:, 0], done[:, 0] = start, False
    dist[:, 0] = -(q @ x[start])
    seen = np.zeros((m, n + 1), dtype=bool)
    seen[:, start] = seen[:, n] = True
    active = np.arange(m)
    while len(active):
        at = np.argmax(~done[active], axis=1)
        open_ = ~done[active, at]
        active, at = active[open_], at[open_]
        if not len(active):
            break
        done[active, at] = True
        near = edges[nodes[active, at]]
        near = np.where(near < 0, n, near)
        fresh = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        d = -_distances(x, np.minimum(near, n - 1), q[active])
        d = np.where(fresh, d, np.inf).astype(np.float32)
        both = np.concatenate([dist[active], d], axis=1)
        names = np.concatenate([nodes[active], np.where(fresh, near, -1)], axis=1)
        flags = np.concatenate([done[active], ~fresh], axis=1)
        best = np.argsort(both, axis=1, kind="stable")[:, :beam]
        dist[active], nodes[active], done[active] = (np.take_along_axis(v, best, axis=1) for v in (both, names, flags))
    return nodes, dist


def prune(x: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of each row's candidates (-1: none); x: plain vectors of one length."""
    m, c = candidates.shape
    order = np.sort(candidates, axis=1)
    twice = np.zeros_like(order, dtype=bool)
    twice[:, 1:] = order[:, 1:] == order[:, :-1]
    ok = (order >= 0) & ~twice & (order != own[:, None])
    vectors = x[np.maximum(order, 0)]
    d = np.where(ok, ((vectors - x[own][:, None]) ** 2).sum(axis=2), np.inf)
    by = np.argsort(d, axis=1, kind="stable")
    order, d, vectors = np.take_along_axis(order, by, 1), np.take_along_axis(d, by, 1), np.take_along_axis(vectors, by[:, :, None], 1)
    alive = np.isfinite(d)
    # Distances among a row's candidates, by one matrix product a row.
    square = (vectors**2).sum(axis=2)
    apart = np.maximum(square[:, :, None] + square[:, None, :] - 2 * (vectors @ vectors.transpose(0, 2, 1)), 0)
    out = np.full((m, degree), -1, dtype=np.int64)
    rows = np.arange(m)
    for k in range(degree):
        first = np.argmax(alive, axis=1)
        has = alive[rows, first]
        if not has.any():
            break
        out[has, k] = order[rows, first][has]
        alive &= ~((alpha * alpha * apart[rows, first] <= d) & has[:, None])
        alive[rows, first] = False
    return out


def build(v: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray, int]:
    """The graph of different vectors: search vectors, edges, start node."""
    n = len(v)
    square = (v**2).sum(axis=1)
    level = np.concatenate([v, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], axis=1).astype(np.float32)
    search = np.concatenate([level, np.zeros((n, 1), np.float32)], axis=1)
    edges = np.full((n, degree), -1, dtype=np.int64)
    start = int(np.argmin(((level - level.mean(axis=0)) ** 2).sum(axis=1)))
    order = np.random.default_rng(11).permutation(n)
    order = np.append(start, order[order != start])
    at = 1
    while at < n:
        batch = order[at : min(n, 2 * at, at + 512)]
        q = np.concatenate([level[batch], np.ones((len(batch), 1), np.float32)], axis=1)
        found, _ = beam_search(search, edges, start, q, beam)
        edges[batch] = prune(level, batch, found, degree, alpha)
        # Back edges: each target prunes its own and the new ones together.
        source, target = np.repeat(batch, degree), edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        who, first, count = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(who), 1024):
            w, f, c = who[lo : lo + 1024], first[lo : lo + 1024], count[lo : lo + 1024]
            # A target that very many chose is offered the new ones in rounds.
            for r in range(0, int(c.max()), 2 * degree):
                some = c > r
                k = np.arange(2 * degree)
                offer = np.where(k[None] + r < c[some, None], source[np.minimum(f[some, None] + k[None] + r, len(source) - 1)], -1)
                together = np.concatenate([edges[w[some]], offer], axis=1)
                many = (together >= 0).sum(axis=1) > degree
                ids = w[some]
                if many.any():
                    edges[ids[many]] = prune(level, ids[many], together[many], degree, alpha)
                few = together[~many]
                few = np.take_along_axis(few, np.argsort(few < 0, axis=1, kind="stable"), 1)[:, :degree]
                edges[ids[~many]] = few
        at += len(batch)
    return search, edges, start


_GRAPH = "size int, n int, ids binary, vectors binary, node binary, search binary, edges binary, start int"


def _build(table: pa.Table) -> pa.Table:
    """A shard's graph as one row: ids and vectors of its rows, the node of each, and the nodes' search vectors and edges."""
    ids = table.column("vec_id").to_numpy()
    size = table.column("size")[0].as_py()
    values = table.column("v").combine_chunks()
    v = (values.values if isinstance(values, pa.ListArray) else pa.concat_arrays(c.values for c in values.chunks)).to_numpy().reshape(-1, size)
    nodes, node = np.unique(v, axis=0, return_inverse=True)
    search, edges, start = build(nodes)
    parts = (ids.astype(np.int64), v, node.ravel().astype(np.int64), search, edges.astype(np.int32))
    return pa.table({"size": pa.array([size], pa.int32()), "n": pa.array([len(nodes)], pa.int32()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("ids", "vectors", "node", "search", "edges"), parts, strict=True)}, "start": pa.array([start], pa.int32())})


def _search(sent, k: int, beam: int):
    """The best of each shard for each query of the block."""

    def answers(ids, v, node, search, edges, start) -> pa.RecordBatch:
        query_ids, q = sent.value
        same = np.flatnonzero([len(x) == v.shape[1] for x in q]) if len(q) else np.zeros(0, np.int64)
        # The smallest k + 1 ids of a node: more can never be among k neighbours.
        by = np.lexsort((ids, node))
        heads = np.flatnonzero(np.append(True, node[by][1:] != node[by][:-1]))
        tails = np.append(heads[1:], len(by))
        nodes = v[by[heads]]
        out: list[tuple[np.ndarray, ...]] = []
        for lo in range(0, len(same), 256):
            part = same[lo : lo + 256]
            queries = np.array([q[i] for i in part], dtype=float)
            length = np.maximum(np.sqrt((queries**2).sum(axis=1, keepdims=True)), 1e-300)
            probe = np.concatenate([queries / length, np.zeros((len(part), 2))], axis=1).astype(np.float32)
            found, _ = beam_search(search, edges, start, probe, max(beam, k + 1))
            for i, own in zip(part.tolist(), found, strict=True):
                own = own[own >= 0]
                near = nodes[own] @ np.asarray(q[i], dtype=float)
                if len(own) > k + 1:  # every node as near as the last one stays, as ids decide between these
                    cut = np.partition(near, len(near) - k - 1)[len(near) - k - 1]
                    own = own[near >= cut - 1e-9 * abs(cut)]
                rows = np.concatenate([by[heads[x] : min(heads[x] + k + 1, tails[x])] for x in own])
                score = np.array([_dot(v[r], q[i]) for r in rows])
                keep = ids[rows] != query_ids[i]
                rows, score = rows[keep], score[keep]
                best = np.lexsort((ids[rows], -score))[:k]
                out.append((np.full(len(best), query_ids[i]), ids[rows][best], score[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                size, n, start = (b.column(c)[r].as_py() for c in ("size", "n", "start"))
                raw = {c: b.column(c)[r].as_buffer() for c in ("ids", "vectors", "node", "search", "edges")}
                yield answers(np.frombuffer(raw["ids"], np.int64), np.frombuffer(raw["vectors"]).reshape(-1, size), np.frombuffer(raw["node"], np.int64), np.frombuffer(raw["search"], np.float32).reshape(n, -1), np.frombuffer(raw["edges"], np.int32).reshape(n, -1).astype(np.int64), start)

    return run


def _dot(a, b) -> float:
    """The inner product in double precision, added from first to last."""
    return float(np.cumsum(np.asarray(a, dtype=float) * np.asarray(b, dtype=float))[-1])


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, beam: int = BEAM, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by the largest inner product.

    vectors: vec_id, embedding; other columns are ignored. Queries are the rows whose vec_id is
    divisible by ``every``; candidates all rows but the query's own id, ties to the smaller id.
    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
    rows without vec_id; of rows that repeat a vec_id, the smallest vector stands; vectors of
    another length than the query's are no candidates of it. No rows give no rows.
    """
    spark = vectors.sparkSession
    shared.ready(spark)
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null").where(fine)
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("size", F.size("v"))
    large = rows.withColumn("large", F.array_max(F.transform("v", F.abs)))
    sized = large.withColumn("length", F.col("large") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("large")) * (x / F.col("large"))))).drop("large").checkpoint()
    asked = sized.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // QUERIES))
    longest = sized.agg(F.max("length")).first()[0] or 1.0
    band = F.least(F.lit(float(BANDS)), F.floor(F.log(F.lit(longest) / F.col("length")) / np.log(BAND))).cast("int")
    banded = sized.withColumn("band", band).drop("length")
    parts = banded.groupBy("band", "size").agg(F.ceil(F.count("*") / shard).alias("parts")).checkpoint()
    shards = int(parts.agg(F.sum("parts")).first()[0] or 1)
    dealt = banded.join(parts, ["band", "size"]).withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(17)), F.col("parts"))).drop("parts")
    # Built once; every block of queries searches the stored graphs.
    # Dealt to a fixed number of tasks: a shard is small beside the work on it, so they must not be put together.
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    built = dealt.repartition(max(shards, least), "band", "size", "shard").groupBy("band", "size", "shard").applyInArrow(_build, _GRAPH)
    graphs, folder = shared.written(built, "graphs")
    found = None
    for b in range(blocks):  # a stated query set, in blocks of bounded size
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").collect()
        sent = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in part], dtype=np.int64), [r["v"] for r in part]))
        got = graphs.repartition(shards).mapInArrow(_search(sent, k, beam), "query_id long, vec_id long, score double").checkpoint()
        sent.unpersist()
        found = got if found is None else found.unionByName(got)
    shared.remove(spark, folder)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
