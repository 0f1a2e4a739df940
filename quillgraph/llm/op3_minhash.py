r"""Near-duplicates by bottom-k sketches of one hash function.

A document is the set of its word shingles, each hashed to 64 bits; its sketch is the
SKETCH smallest. Texts with equal sets are one class, and only classes are compared. Equal
means an equal 128-bit digest of the set; a class goes by the digest's first half, and by
its second half where two digests share the first.

Inverted lists. A list belongs to RUN neighbouring values of a sketch, in order. If two
sets have a Jaccard of 0.8 or more, a union of n values holds 0.8 n shared ones, cut by at
most 0.2 n others into runs, so some run has 0.8 n / (0.2 n + 1) shared values at least: over
1 for n >= 2, over 2 for n >= 6, over 3 for n >= 16. Sets that a sketch holds whole thus
always meet (runs of 2, 3 and 4 by size); of larger sets, a pair just at 0.8 misses with
a probability near 0.8 ** SKETCH, about 5e-10. No list is capped.

Short lists give all their pairs, so a class has fewer than SKETCH * LONG partners. Lists of
more than LONG classes join into families. Their members first meet HUBS members each that
stand in most long lists; who is linked through a hub is of one group and not compared again.
What is left is compared, with each other and with the largest group, in blocks of similar set
size, a task for two blocks; a task returns a star for each group it finds, never its pairs.

A pair is estimated from the SKETCH smallest values of the union: only sketches travel for
that. The pairs left form small groups; a group's full sets meet in one task, once each, and
the pairs are verified on them (pairs of a large group by two joins). Links of classes then
make components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared
from .components import connected_components, spanning
from .shared import U

SKETCH = 96
#: Classes of a list from which it is compared in blocks.
LONG = 50
BLOCK = 256
#: Members that a family's others meet first.
HUBS = 8
#: Classes, and values of their sets, of a group of pairs that one task verifies.
GROUP, GROUP_VALUES = 64, 4 << 20
#: Union-sketch estimates under the threshold by more than this are dropped: seven standard deviations at 0.8.
MARGIN = 0.29

_LOWER = shared.lower_ascii()
_SMALL, _FULL = 32, 20


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingle hashes of each row, and the row offsets among them."""
    flat = _LOWER[flat]
    starts, ends, rows = shared.word_spans(flat, offsets, shared.SPACED_WORD)
    base = shared.span_hashes(flat, starts, ends)
    count = np.diff(rows)
    row = np.repeat(np.arange(len(count)), count)
    hashes = base.copy()
    for k in range(1, words):
        hashes[: len(base) - k] = shared.mix(hashes[: len(base) - k] + shared.mix(base[k:]) * U(2 * k + 1))
    full = np.arange(len(base)) + words <= rows[row + 1] if len(base) else np.zeros(0, bool)
    values, owner = hashes[full], row[full]
    # Rows of fewer words than a shingle: the whole sequence as one.
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(words - 1):
            some = count[short] > k
            whole[some] = shared.mix(whole[some] + base[rows[short[some]] + k] + U(k))
        values, owner = np.concatenate([values, shared.mix(whole + U(1))]), np.concatenate([owner, short])
    by = np.lexsort((values, owner))
    values, owner = values[by], owner[by]
    if len(values):
        new = np.append(True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1]))
        values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(count) + 1))


def set_class(values: np.ndarray, rows: np.ndarray, avoid: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The class of each set, and the other half of its digest; ``avoid``: first halves that different sets share."""
    raw = memoryview(np.ascontiguousarray(values)).cast("B")
    digests = b"".join(hashlib.blake2b(raw[8 * a : 8 * z], digest_size=16).digest() for a, z in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True))
    first, second = np.frombuffer(digests, np.int64).reshape(-1, 2).T
    first = first & ((1 << bits) - 1) if bits < 64 else first
    return np.where(np.isin(first, avoid), second, first), second


def _digest(words: int, avoid: np.ndarray, bits: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in shared.blocks(batches):
            values, rows = shingle_sets(*shared.text_array(b.column("text")), words)
            cls, other = set_class(values, rows, avoid, bits)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(rows).astype(np.int64)), pa.array(cls), pa.array(other)], ["doc_id", "n_shingles", "cls", "other"])

    return run


def list_keys(values: np.ndarray, rows: np.ndarray, classes: np.ndarray, sketch: int = SKETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List keys, their classes, and the classes' set sizes on a logarithmic scale."""
    sizes = np.diff(rows)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - rows[row] if len(values) else np.zeros(0, np.int64)
    keys, owners = [], []
    for run, low, high in ((2, 4, 5), (3, 5, _SMALL), (4, _FULL, 1 << 62)):
        at = np.flatnonzero((sizes[row] >= low) & (sizes[row] <= high) & (place + run <= np.minimum(sizes[row], sketch)))
        key = values[at] + U(run)
        for k in range(1, run):
            key = shared.mix(key) + values[at + k]
        keys.append(shared.mix(key))
        owners.append(row[at])
    owner = np.concatenate(owners)
    scale = np.floor(np.log(np.maximum(sizes, 1)) / np.log(1.05)).astype(np.int16)
    return np.concatenate(keys), classes[owner], scale[owner]


_LISTED = "bucket int, keys binary, classes binary, scales binary"


def _list(words: int, count: int, avoid: np.ndarray, bits: int):
    def send(held) -> Iterator[pa.RecordBatch]:
        keys, classes, scales = (np.concatenate(x) for x in zip(*held, strict=True))
        which = (keys % U(count)).astype(np.int64)
        by = np.lexsort((classes, which))
        edges = np.flatnonzero(np.diff(which[by], prepend=-1))
        parts = [by[a:z] for a, z in zip(edges, np.append(edges[1:], len(by)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([int(which[p[0]]) for p in parts], pa.int32()), *(pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (keys, classes, scales))], ["bucket", "keys", "classes", "scales"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, have, seen = [], 0, set()
        for b in shared.blocks(batches):
            values, rows = shingle_sets(*shared.text_array(b.column("text")), words)
            classes, _ = set_class(values, rows, avoid, bits)
            # Copies in one task list their set once.
            fresh = np.array([not (c in seen or seen.add(c)) for c in classes.tolist()], dtype=bool)
            owner = np.repeat(np.arange(len(classes)), np.diff(rows))
            values, sizes = values[fresh[owner]], np.diff(rows)[fresh]
            keys, *more = list_keys(values, np.append(0, np.cumsum(sizes)), classes[fresh])
            held.append((keys & U((1 << bits) - 1), *more))
            have += len(held[-1][0])
            if have > 2_000_000:
                yield from send(held)
                held, have, seen = [], 0, set()
        if have:
            yield from send(held)

    return run


def _meet(long: int):
    """A bucket of lists: pairs of short lists, and the stars of long ones."""

    def run(table: pa.Table) -> pa.Table:
        keys, classes, scales = (np.concatenate([np.frombuffer(x, d) for x in table.column(c).to_pylist()]) for c, d in (("keys", np.uint64), ("classes", np.int64), ("scales", np.int16)))
        by = np.lexsort((classes, keys))
        keys, classes, scales = keys[by], classes[by], scales[by]
        new = np.append(True, (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])) if len(keys) else np.zeros(0, bool)
        keys, classes, scales = keys[new], classes[new], scales[new]
        head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(keys)))
        none = np.zeros(0, np.int64)
        left, right = [none], [none]
        for n in np.unique(size[(size > 1) & (size <= long)]).tolist():
            at = head[size == n][:, None] + np.arange(n)
            i, j = np.triu_indices(n, 1)
            a, b = at[:, i].ravel(), at[:, j].ravel()
            # Sets of 0.8 or more differ in size by a fifth at most: under 6 steps of the scale.
            near = np.abs(scales[a] - scales[b]) <= 6
            left.append(classes[a[near]])
            right.append(classes[b[near]])
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
        own = np.repeat(size > long, size)
        first = np.repeat(head, size)[own]
        stars = np.unique(np.stack([classes[own], classes[first]], axis=1), axis=0)
        out = np.concatenate([pairs, stars])
        return pa.table({"a": pa.array(out[:, 0]), "b": pa.array(out[:, 1]), "family": pa.array(np.arange(len(out)) >= len(pairs))})

    return run


def _sets(words: int, avoid: np.ndarray, bits: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in shared.blocks(batches):
            values, rows = shingle_sets(*shared.text_array(b.column("text")), words)
            # Another text of the same doc_id is of another class.
            own = np.flatnonzero(set_class(values, rows, avoid, bits)[0] == b.column("cls").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("cls").take(pa.array(own)), pa.array(np.diff(rows)[own]), pa.array([values[rows[i] : rows[i + 1]].tobytes() for i in own.tolist()], pa.binary())], ["cls", "n", "values"])

    return run


def _near(x: np.ndarray, y: np.ndarray, n: int, m: int, percent: int, sketch: int = SKETCH) -> bool:
    """Whether sketches of sets of n and m values leave room for a link: by size, then by the estimate from the union's smallest values."""
    small, large = sorted((n, m))
    if 100 * small < percent * large:
        return False
    head = np.sort(np.concatenate([x[:sketch], y[:sketch]]))
    twice = np.flatnonzero(head[1:] == head[:-1])
    if len(head) - len(twice) <= sketch:
        return True
    # Places of the shared values in the union of the sketches.
    return int((twice - np.arange(len(twice)) < sketch).sum()) / sketch >= percent / 100 - MARGIN


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _estimate(percent: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_near(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), n, m, percent) for x, y, n, m in zip(*(b.column(c).to_pylist() for c in ("ha", "hb", "na", "nb")), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(percent: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b.column("va").to_pylist(), b.column("vb").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify_group(percent: int):
    """The pairs of a group, on its sets."""

    def run(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        own = {c: np.frombuffer(v.as_buffer(), np.uint64) for c, v in zip(sets.column("cls").to_pylist(), sets.column("values"), strict=True)}
        keep = [_linked(own[a], own[b], percent) for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True)]
        return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of the pairs (a, b); sets: cls, n, values."""
    heads = sets.select("cls", "n", F.substring("values", 1, 8 * SKETCH).alias("head"))
    one = pairs.join(heads.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("head").alias("ha")), "a")
    two = one.join(heads.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("head").alias("hb")), "b")
    near = two.mapInArrow(_estimate(percent), "a long, b long").checkpoint()
    place = connected_components(near).withColumnRenamed("node", "cls")
    sized = place.join(sets.select("cls", "n"), "cls")
    fits = sized.groupBy("component").agg(F.count("*").alias("c"), F.sum("n").alias("total")).select("component", ((F.col("c") <= GROUP) & (F.col("total") <= GROUP_VALUES)).alias("fits"))
    sized = place.join(fits, "component").checkpoint()
    placed = near.join(sized.select(F.col("cls").alias("a"), F.col("component").alias("unit"), F.col("fits").alias("small")), "a")
    small = sets.select("cls", "values").join(sized.where("fits"), "cls").groupBy("component").cogroup(placed.where("small").groupBy("unit"))
    links = small.applyInArrow(_verify_group(percent), "a long, b long")
    full = sets.join(sized.where("not fits"), "cls").select("cls", "values")
    large = placed.where("not small").select("a", "b").join(full.select(F.col("cls").alias("a"), F.col("values").alias("va")), "a").join(full.select(F.col("cls").alias("b"), F.col("values").alias("vb")), "b")
    return links.unionByName(large.mapInArrow(_verify(percent), "a long, b long"))


def _compare(percent: int):
    """Two blocks of a family: counts of shared values by matrix products over a bounded number of columns at a time."""

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, cls = table.column("block").to_numpy(), table.column("cls").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("values").to_pylist()]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        count = np.bincount(column, minlength=len(values))
        many = count[column] > 1
        used, column = np.unique(column[many], return_inverse=True)
        owner = owner[many]
        by = np.argsort(column, kind="stable")
        column, owner = column[by], owner[by]
        both = np.zeros((len(left), len(right)), dtype=np.float32)
        for low in range(0, len(used), 8192):
            a, z = np.searchsorted(column, [low, low + 8192])
            x = np.zeros((len(sets), min(8192, len(used) - low)), dtype=np.float32)
            x[owner[a:z], column[a:z] - low] = 1
            both += x[left] @ x[right].T
        both = both.astype(np.int64)
        union = sizes[left][:, None] + sizes[right][None, :] - both
        u, v = np.nonzero(100 * both >= percent * union)
        u, v = cls[left[u]], cls[right[v]]
        a, b = spanning(u[u != v], v[u != v])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80, bits: int = 64) -> DataFrame:
    r"""One row per input row: doc_id, n_shingles, component_id, kept.

    A-Z are lower-cased; words are ``[^\x20\x09-\x0D]+``; a set holds the different runs of
    ``words`` words, or the whole sequence if it is shorter. Documents with
    100 * intersection >= percent * union are linked; component_id is the smallest doc_id
    reachable. Texts that are null or without words are linked with nothing. Rows that share
    a doc_id are one document; a row without doc_id links with nothing, has no component_id
    and is kept. Other columns are ignored. ``percent`` from 80 on. No rows give no rows. A text's
    set is built in memory at some hundred bytes a word, whatever its length. ``bits``: of the
    hashes that bring sets together; the result does not depend on it.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")  # shorter runs would be needed below
    spark = docs.sparkSession
    shared.ready(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    count = shared.buckets(shared.text_bytes(docs), 8 << 20)
    avoid = np.zeros(0, np.int64)
    while True:
        rows = docs.mapInArrow(_digest(words, avoid, bits), "doc_id long, n_shingles long, cls long, other long").checkpoint()
        known = rows.where("doc_id is not null and n_shingles > 0")
        # Classes of several digests: n ** 2 / 2 ** 65 of n classes are expected.
        mixed = [r["cls"] for r in known.groupBy("cls").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high").collect()]
        if not mixed:
            break
        avoid = np.union1d(avoid, np.array(mixed, np.int64))
    classes = known.groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    listed = docs.where("doc_id is not null").select("text").mapInArrow(_list(words, count, avoid, bits), _LISTED)
    met = shared.spread(listed, "bucket", -(-count // 4)).groupBy("bucket").applyInArrow(_meet(LONG), "a long, b long, family boolean").checkpoint()

    stars = met.where("family").select("a", "b")
    families = not stars.isEmpty()
    pairs = met.where("not family").select("a", "b").distinct()
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    if families:
        members = connected_components(stars).select(F.col("node").alias("cls"), "component").checkpoint()
        # A family's members are compared as such.
        ends = pairs.join(members.select(F.col("cls").alias("a"), F.col("component").alias("f")), "a", "left").join(members.select(F.col("cls").alias("b"), F.col("component").alias("g")), "b", "left")
        pairs = ends.where("f is null or g is null or f <> g").select("a", "b")
        wanted = wanted.unionByName(members.select("cls"))
    sets = docs.join(wanted.distinct().join(classes, "cls"), "doc_id").select("cls", "text").mapInArrow(_sets(words, avoid, bits), "cls long, n long, values binary").dropDuplicates(["cls"]).checkpoint()
    shared.settle(spark)
    links = _verified(pairs, sets, percent)
    if families:
        links = links.unionByName(_family_links(sets, members, stars, percent))
    links = links.join(classes.select(F.col("cls").alias("a"), F.col("doc_id").alias("x")), "a").join(classes.select(F.col("cls").alias("b"), F.col("doc_id").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # One text's class may hold rows of several ids, and one id several classes: ids are the nodes.
    twice = known.groupBy("doc_id").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high")
    own = known.join(twice, "doc_id", "left_semi").join(classes.withColumnRenamed("doc_id", "b"), "cls").select(F.col("doc_id").alias("a"), "b")
    found = connected_components(links.unionByName(own))

    placed = rows.join(classes.withColumnRenamed("doc_id", "first"), "cls", "left").join(found.withColumnRenamed("node", "first"), "first", "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.coalesce("component", "first"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _hub_links(full: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """Links of families' members to the HUBS of them that stand in most long lists. full: component, cls, n, values."""
    listed = stars.groupBy(F.col("a").alias("cls")).agg(F.count("*").alias("lists"))
    ranked = full.select("component", "cls").join(listed, "cls", "left")
    best = W.partitionBy("component").orderBy(F.desc_nulls_last("lists"), "cls")
    hubs = ranked.withColumn("r", F.row_number().over(best)).where(F.col("r") <= HUBS).select("component", "cls")
    # Every slice of a family's members meets its hubs.
    slices = full.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("slices"))
    sides = full.join(slices, "component").withColumn("i", F.pmod(F.xxhash64("cls"), F.col("slices")).cast("int"))
    own = sides.select("component", "i", F.lit(0).alias("block"), "cls", "values")
    hub = full.join(hubs, ["component", "cls"]).join(slices, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("i"), F.lit(1).alias("block"), "cls", "values")
    tasks = own.unionByName(hub).withColumnRenamed("i", "slice").withColumns({"i": F.lit(0), "j": F.lit(1)})
    return tasks.groupBy("component", "slice").applyInArrow(_compare(percent), "a long, b long")


def _family_links(sets: DataFrame, members: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """Links inside families: those to hubs, and those of the members left over; a block holds neighbouring set sizes."""
    full = members.join(sets, "cls").select("component", "cls", "n", "values")
    first = _hub_links(full, stars, percent).checkpoint()
    own = members.join(sets.select("cls", "n"), "cls").join(connected_components(first).select(F.col("node").alias("cls"), F.col("component").alias("group")), "cls", "left")
    own = own.withColumn("group", F.coalesce("group", "cls"))
    # The largest group of a family needs no comparison with itself.
    sizes = own.groupBy("component", "group").agg(F.count("*").alias("c")).groupBy("component").agg(F.max(F.struct("c", "group")).alias("x"))
    own = own.join(sizes.select("component", F.col("x.group").alias("largest")), "component").withColumn("rest", (F.col("group") != F.col("largest")).cast("int")).drop("largest")
    # Ranks by size without one task for a family: sizes are counted, and members of a size dealt by hash.
    by_size = own.groupBy("component", "rest", "n").agg(F.count("*").alias("c"))
    before = by_size.withColumn("before", F.sum("c").over(W.partitionBy("component", "rest").orderBy("n")) - F.col("c")).drop("c")
    rank = F.row_number().over(W.partitionBy("component", "rest", "n").orderBy("cls")) - 1
    placed = own.join(before, ["component", "rest", "n"]).withColumn("block", (2 * ((F.col("before") + rank) / BLOCK).cast("int") + F.col("rest")).cast("int")).select("component", "block", "cls", "n").checkpoint()
    edges = placed.groupBy("component", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    i = edges.select("component", F.col("block").alias("i"), F.col("low").alias("li"), F.col("high").alias("hi"))
    j = edges.where("block % 2 = 1").select("component", F.col("block").alias("j"), F.col("low").alias("lj"), F.col("high").alias("hj"))
    apart = (F.col("hi") * 100 < F.col("lj") * percent) | (F.col("hj") * 100 < F.col("li") * percent)
    tasks = j.join(i, "component").where(((F.col("i") % 2 == 0) | (F.col("i") <= F.col("j"))) & ~apart).select("component", "i", "j")
    sides = tasks.select("component", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    full = placed.select("component", "block", "cls").join(sets.select("cls", "values"), "cls")
    return first.unionByName(sides.join(full, ["component", "block"]).groupBy("component", "i", "j").applyInArrow(_compare(percent), "a long, b long"))
