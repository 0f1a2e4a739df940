"""A Merkle manifest of a table: a root over all rows, and for each row a proof against it.

Rows are leaves. A source's leaves, in the order of doc_id, form a tree of fanout 3 without
padding: while several nodes remain, every three consecutive ones become one, the last run being
as short as it is. The sources' roots are the leaves of one more such tree.

The order is cut into ranges of a bounded number of leaves, each of which knows the index of its
first leaf, so the tree's shape is known everywhere. A range keeps a mountain range: a stack of
nodes onto which leaves are pushed; a node that completes a run of siblings carries, so the stack
ends as the peaks, the nodes whose parent has a child in another range. A range emits its peaks
(a few for each level and edge) and drops the rest. ``FAN`` neighbouring ranges' peaks are the
next round's input, in which unaligned edges meet; after log_FAN(ranges) rounds every source has
one node. Proofs come down the same way: a range recomputes its runs, gets the path above its
peaks, and folds each leaf. No task sees more than a range, or FAN ranges' peaks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Children of a node.
FANOUT = 3
#: Leaves of a range, about; and ranges whose peaks meet in a task of the next round.
RANGE, FAN = 20_000, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Node = tuple[int, int]


def field(value: Column) -> Column:
    """A field as hashed: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**replaced: Column) -> Column:
    """The digest of a row's FIELDS, some of them replaced."""
    return F.sha2(F.concat(*[field(replaced.get(c, F.col(c))) for c in FIELDS]).cast("binary"), 256)


def tampered() -> Column:
    """The digest of the row with the text's line feeds deleted, for rows whose doc_id has an even crc32; else null."""
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    return F.when(even & F.col("text").contains("\n"), leaf(text=F.replace(F.col("text"), F.lit("\n"), F.lit(""))))


# -- the shape of a tree, and the stack -----------------------------------------------


def sizes(n: int) -> list[int]:
    """Nodes of each level of a tree of n leaves, the last one being 1."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FANOUT))
    return out


def digest(parts) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


class Range:
    """The part of one tree that a range can complete: push nodes in order, then read peaks and runs."""

    def __init__(self, n: int):
        self.count = sizes(n)
        self.stack: list[tuple[int, int, bytes]] = []
        #: Completed runs in the order of completion: the parent's place, the children's digests.
        self.runs: list[tuple[Node, list[bytes]]] = []

    def push(self, level: int, index: int, value: bytes) -> None:
        stack = self.stack
        stack.append((level, index, value))
        while level < len(self.count) - 1:
            first = index - index % FANOUT
            width = min(FANOUT, self.count[level] - first)
            if index != first + width - 1 or len(stack) < width or stack[-width][:2] != (level, first):
                return
            children = [s[2] for s in stack[-width:]]
            del stack[-width:]
            level, index = level + 1, index // FANOUT
            self.runs.append(((level, index), children))
            stack.append((level, index, digest(children)))

    def is_top(self, level: int) -> bool:
        return level == len(self.count) - 1

    def paths(self, above: dict[Node, tuple[bytes, bytes]]) -> Iterator[tuple[Node, tuple[bytes, bytes]]]:
        """The nodes pushed or completed, each with its path to the root, from those of the peaks.

        A path is the siblings' digests from the node upwards, left to right, and a byte for each
        level: the node's place in its run, and the run's width.
        """
        known = dict(above)
        yield from above.items()
        for (level, index), children in reversed(self.runs):
            siblings, shape = known.pop((level, index))
            for k, _ in enumerate(children):
                node = (level - 1, index * FANOUT + k)
                path = (b"".join(children[:k] + children[k + 1 :]) + siblings, bytes([k * 8 + len(children)]) + shape)
                if level > 1:
                    known[node] = path
                yield node, path


def fold(value: bytes, siblings: bytes, shape: bytes) -> bytes:
    """The root that a leaf and its path give."""
    at = 0
    for step in shape:
        place, width = divmod(step, 8)
        others = siblings[at : at + 64 * (width - 1)]
        at += len(others)
        value = digest([others[: 64 * place], value, others[64 * place :]])
    return value


# -- Spark ------------------------------------------------------------------------------

_NODES = "part long, grp string, n long, level int, idx long, digest binary"
_PATHS = "part long, grp string, level int, idx long, siblings binary, shape binary"


@dataclass
class Tree:
    """A forest: its leaves by ranges, each range's place in its groups, the rounds' inputs, and the top node of each group with the round that completed it."""

    leaves: DataFrame
    starts: DataFrame
    rounds: list[DataFrame]
    tops: DataFrame
    folder: str


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, k = TaskContext.get().partitionId(), 0
    for b in batches:
        own = pa.array([part] * b.num_rows, pa.int64()), pa.array(range(k, k + b.num_rows), pa.int64())
        k += b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, *own], [*b.schema.names, "part", "k"])


def _emit(part: int, trees: list[tuple[str, int, Range]]) -> pd.DataFrame:
    rows = [(part, grp, n, level, index, value) for grp, n, tree in trees for level, index, value in tree.stack]
    return pd.DataFrame(rows, columns=["part", "grp", "n", "level", "idx", "digest"])


def _grow(rows: pd.DataFrame, at: dict[str, tuple[int, int]]) -> list[tuple[str, int, Range]]:
    """The trees of a range's leaves, in order; at: each group's first index here and its number of leaves."""
    out = []
    for grp, values in rows.sort_values("k").groupby("grp", sort=False)["digest"]:
        start, n = at[grp]
        tree = Range(n)
        for i, value in enumerate(values):
            tree.push(0, start + i, value.encode())
        out.append((grp, n, tree))
    return out


def _climb_leaves(key: tuple, rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    at = {g: (s, n) for g, s, n in zip(starts["grp"], starts["start"], starts["n"], strict=True)}
    return _emit(key[0], _grow(rows, at))


def _meet(rows: pd.DataFrame) -> list[tuple[str, int, Range]]:
    """The trees of a round's peaks, in the order of the first leaf that each covers."""
    out = []
    for grp, own in rows.groupby("grp", sort=True):
        n = int(own["n"].iloc[0])
        tree = Range(n)
        nodes = [(index * FANOUT**level, level, index, value) for level, index, value in zip(own["level"].tolist(), own["idx"].tolist(), own["digest"], strict=True)]
        for _, level, index, value in sorted(nodes):
            tree.push(level, index, bytes(value))
        out.append((grp, n, tree))
    return out


def _climb(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return _emit(key[0], _meet(rows))


def _top(n: Column) -> Column:
    """The level of the top node of n leaves."""
    return sum((F.when(n > FANOUT**k, 1).otherwise(0) for k in range(40)), F.lit(0))


def climb(leaves: DataFrame, order: list[str]) -> Tree:
    """The trees of the leaves' groups. leaves: grp (not null), digest (hex), the columns of the order, and more.

    Rows equal in grp and order are taken in the order of their digests, equal ones in any.
    """
    spark = leaves.sparkSession
    leaves = leaves.checkpoint()
    parts = max(1, -(-leaves.count() // RANGE))
    tie = shared.fresh("tie", leaves.columns)
    ordered = leaves.withColumn(tie, F.rand(11)).repartitionByRange(parts, "grp", *order, "digest", tie).sortWithinPartitions("grp", *order, "digest", tie).drop(tie)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields)
    numbered, folder = shared.written(ordered.mapInArrow(_number, f"{fields}, part long, k long"), "merkle-leaves")
    counts = numbered.groupBy("part", "grp").agg(F.count("*").alias("c"))
    starts = counts.selectExpr("part", "grp", "sum(c) over (partition by grp order by part) - c as start", "sum(c) over (partition by grp) as n").checkpoint()
    nodes = numbered.select("part", "k", "grp", "digest").groupBy("part").cogroup(starts.groupBy("part")).applyInPandas(_climb_leaves, _NODES).checkpoint()
    rounds, tops, number = [], [], 0
    while True:
        done = F.col("level") == _top(F.col("n"))
        tops.append(nodes.where(done).withColumn("round", F.lit(number)))
        peaks = nodes.where(~done)
        if peaks.isEmpty():
            break
        number += 1
        peaks = peaks.withColumns({"source_part": F.col("part"), "part": F.floor(F.col("part") / FAN)})
        rounds.append(peaks)
        nodes = peaks.drop("source_part").groupBy("part").applyInPandas(_climb, _NODES).checkpoint()
    found = tops[0]
    for t in tops[1:]:
        found = found.unionByName(t)
    return Tree(numbered, starts, rounds, found, folder)


def _split(paths: pd.DataFrame) -> dict[str, dict[Node, tuple[bytes, bytes]]]:
    out: dict[str, dict[Node, tuple[bytes, bytes]]] = {}
    for grp, level, index, siblings, shape in zip(paths["grp"], paths["level"].tolist(), paths["idx"].tolist(), paths["siblings"], paths["shape"], strict=True):
        out.setdefault(grp, {})[(level, index)] = (bytes(siblings), bytes(shape))
    return out


def _descend(key: tuple, rows: pd.DataFrame, paths: pd.DataFrame) -> pd.DataFrame:
    above, out = _split(paths), []
    wanted = {(g, level, i): p for g, level, i, p in zip(rows["grp"], rows["level"].tolist(), rows["idx"].tolist(), rows["source_part"].tolist(), strict=True)}
    for grp, _, tree in _meet(rows):
        for (level, index), path in tree.paths(above[grp]):
            if (grp, level, index) in wanted:
                out.append((wanted[grp, level, index], grp, level, index, *path))
    return pd.DataFrame(out, columns=["part", "grp", "level", "idx", "siblings", "shape"])


def peak_paths(tree: Tree, above: DataFrame) -> DataFrame:
    """The paths of every range's peaks. above: each group's siblings and shape over its top node."""
    tops = tree.tops.join(above, "grp").select("part", "grp", "level", "idx", "siblings", "shape", "round")
    paths = None
    for number in range(len(tree.rounds), -1, -1):
        own = tops.where(F.col("round") == number).drop("round")
        paths = own if paths is None else own.unionByName(paths)
        if number:
            peaks = tree.rounds[number - 1]
            peaks = peaks.toDF(*peaks.columns)
            paths = peaks.groupBy("part").cogroup(paths.toDF(*paths.columns).groupBy("part")).applyInPandas(_descend, _PATHS)
    return paths


def leaf_paths(tree: Tree, above: DataFrame, finish, schema: str) -> DataFrame:
    """finish(a range's rows of a group, in order, their paths, the group's root) for every range and group."""
    tops = tree.tops.select("grp", F.col("digest").alias("top"))
    paths = peak_paths(tree, above).join(tree.starts.join(tops, "grp"), ["part", "grp"])

    def run(key: tuple, rows: pd.DataFrame, paths: pd.DataFrame) -> pd.DataFrame:
        at = {g: (int(s), int(n)) for g, s, n in zip(paths["grp"], paths["start"], paths["n"], strict=True)}
        root = {g: bytes(t).decode() for g, t in zip(paths["grp"], paths["top"], strict=True)}
        above, out = _split(paths), []
        own = dict(list(rows.sort_values("k").groupby("grp", sort=False)))
        for grp, _, part in _grow(rows, at):
            found = {index: path for (level, index), path in part.paths(above[grp]) if level == 0}
            out.append(finish(own[grp], [found[at[grp][0] + i] for i in range(len(own[grp]))], root[grp]))
        return pd.concat(out)

    return tree.leaves.groupBy("part").cogroup(paths.toDF(*paths.columns).groupBy("part")).applyInPandas(run, schema)


def _proofs(rows: pd.DataFrame, paths: list[tuple[bytes, bytes]], root: str) -> pd.DataFrame:
    return pd.DataFrame({"grp": rows["of"].to_numpy(), "siblings": [p[0] for p in paths], "shape": [p[1] for p in paths]})


def _verify(rows: pd.DataFrame, paths: list[tuple[bytes, bytes]], subroot: str) -> pd.DataFrame:
    proofs = [hashlib.sha256(siblings).hexdigest() for siblings, _ in paths]
    folded = [fold((changed or value).encode(), *path).decode() for value, changed, path in zip(rows["digest"], rows["tampered"], paths, strict=True)]
    return pd.DataFrame({"id": rows["id"].to_numpy(), "leaf": rows["digest"].to_numpy(), "subroot": subroot, "proof_sha256": proofs, "folded_root": folded})


def manifest(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    docs: FIELDS; other columns are ignored. A null field counts as such, a null source is a
    source of its own before all others, null ids come first. Rows that repeat an id are ordered
    by their leaf. A source of one row has that leaf as its subroot; a table of one source has
    that subroot as its root; without any siblings the proof is the digest of nothing. Empty
    tables give no rows. folded_root is what the row's proof gives for its leaf, or for the leaf
    of the tampered row where there is one; verified tells whether that is the root.
    """
    spark = docs.sparkSession
    shared.ready(spark)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("doc_id").cast("string").alias("id"),  # pandas has no whole numbers beside nulls
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("grp"),
        leaf().alias("digest"),
        tampered().alias("tampered"),
    )
    tree = climb(rows, ["doc_id"])
    subroots = tree.tops.select(F.lit("").alias("grp"), F.col("grp").alias("of"), F.decode("digest", "utf-8").alias("digest"))
    whole = climb(subroots, ["of"])
    none = F.lit(b"")
    over = leaf_paths(whole, whole.tops.select("grp", none.alias("siblings"), none.alias("shape")), _proofs, "grp string, siblings binary, shape binary").checkpoint()
    found = leaf_paths(tree, over, _verify, "id string, leaf string, subroot string, proof_sha256 string, folded_root string")
    top = whole.tops.first()
    root = F.lit(bytes(top["digest"]).decode() if top else None).cast("string")
    out = found.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")).checkpoint()
    for folder in (tree.folder, whole.folder):
        shared.remove(spark, folder)
    return out
