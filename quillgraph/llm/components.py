"""Connected components of a link table, by hooking to the smallest neighbour and jumping over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reached) for the links given, without the smallest nodes themselves."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


_LINKS = "a long, b long, moved boolean"
#: Links of a round for each task that shrinks and writes them.
EACH = 100_000


def _shrink(batches) -> Iterator[pa.RecordBatch]:
    """A task's links, as a star for each component that it sees; moved: whether any of them was."""
    held, have = [], 0

    def give() -> pa.RecordBatch:
        a, b, moved = (np.concatenate(x) for x in zip(*held, strict=True))
        a, b = spanning(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), moved.any()))], ["a", "b", "moved"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy(), batch.column("moved").to_numpy(zero_copy_only=False)))
        have += batch.num_rows
        if have > 1_000_000:
            yield give()
            held, have = [], 0
    if have:
        yield give()


def _stars(links: DataFrame) -> bool:
    """Whether the links (a > b) are stars: no node is the larger end of two that differ, or the larger of one and the smaller of another."""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("up")).unionByName(links.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("up")))
    each = ends.groupBy("node").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.count("up").alias("ups"), F.count("*").alias("n"))
    return each.where("low <> high or (ups > 0 and ups < n)").isEmpty()


def _round(links: DataFrame) -> DataFrame:
    """The links (a > b) with a's neighbours b hooked to the smallest of them, and each b replaced by its own smallest one.

    moved: whether that is another link; if none is, the links are stars and each is there once.
    """
    near = links.groupBy("a").agg(F.collect_set("b").alias("near")).select("a", "near", F.array_min("near").alias("low"))
    hook = F.transform("near", lambda b: F.struct(F.when(b == F.col("low"), F.col("a")).otherwise(b).alias("a"), F.col("low").alias("b"), (F.size("near") > 1).alias("moved")))
    hooked = near.select(F.explode(hook).alias("x")).select("x.*")
    jumps = hooked.join(near.select(F.col("a").alias("b"), F.col("low").alias("next")), "b", "left")
    return jumps.select("a", F.coalesce("next", "b").alias("b"), (F.col("moved") | F.col("next").isNotNull()).alias("moved"))


def connected_components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node reachable.

    links: long columns a and b without nulls, any direction, repeats and self-links allowed.
    A task's links leave it as stars, so a node is the larger end of one link of a task at most,
    and a node's neighbours in a group are no more than the tasks. Each round is one grouping and
    one join, two shuffles; every node is hooked or hooked to, and paths halve, so rounds grow
    with the logarithms of both; the last one finds nothing to move, and there is none if the links
    are stars. A round's links are written, and removed after the next round has been.
    """
    spark = links.sparkSession
    edges, folder = shared.written(links.where("a <> b").select("a", "b", F.lit(True).alias("moved")).mapInArrow(_shrink, _LINKS), "links")
    settled, n = _stars(edges), edges.count()
    edges = edges.dropDuplicates(["a"]) if settled else edges
    for _ in range(most):
        if settled:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        # A task for each core at least; where few links are left, more would only cost their start and a file each.
        parts = max(spark.sparkContext.defaultParallelism, -(-n // EACH))
        new, place = shared.written(_round(edges).coalesce(parts).mapInArrow(_shrink, _LINKS), "links")
        shared.remove(spark, folder)
        edges, folder = new, place
        n, moved = edges.agg(F.count("*"), F.max("moved")).first()
        settled = not moved
        shared.settle(spark)
    raise RuntimeError(f"components did not settle in {most} rounds")
