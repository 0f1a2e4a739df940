"""Versioned ingest: what changed, what went, three-way sync, and stored generations."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashes import bit_set, may_hold
from ..functions.text import normal_path


class Conflict(Exception):
    """The state moved on since it was read."""


def content_hash(markdown: Column) -> Column:
    return F.sha2(markdown, 256)


def later_wins(inputs: DataFrame, key: str = "path", order: str = "sequence") -> DataFrame:
    """One row per key, the last by order."""
    return inputs.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_k = 1").drop("_k")


def classify(current: DataFrame, inputs: DataFrame, parser_version: str = "1") -> DataFrame:
    """Every document with its action: added, changed, unchanged, or kept when it is not among the inputs.

    current: doc, path, content_hash, parser_version, revision, epoch; inputs: doc, path, markdown,
    and perhaps expected_revision. A change of content, path or parser raises revision and epoch;
    conflict: an expected revision that is not the current one, or a path another document owns.
    """
    new = inputs.select("doc", normal_path(F.col("path")).alias("new_path"), content_hash(F.col("markdown")).alias("new_hash"), (F.col("expected_revision") if "expected_revision" in inputs.columns else F.lit(None).cast("long")).alias("expected"))
    owners = current.select(F.col("path").alias("new_path"), F.col("doc").alias("owner"))
    joined = current.join(new, "doc", "full_outer").join(owners, "new_path", "left")
    same = (F.col("path") == F.col("new_path")) & (F.col("content_hash") == F.col("new_hash")) & (F.col("parser_version") == parser_version)
    conflict = (F.col("owner") != F.col("doc")) | (F.col("expected").isNotNull() & (F.col("expected") != F.coalesce("revision", F.lit(0))))
    action = F.when(F.col("new_hash").isNull(), "kept").when(F.col("new_path").isNull(), "invalid").when(F.coalesce(conflict, F.lit(False)), "conflict").when(F.col("revision").isNull(), "added").when(same, "unchanged").otherwise("changed")
    up = action.isin("added", "changed").cast("long")
    return joined.select("doc", action.alias("action"), (F.coalesce("revision", F.lit(0)) + up).alias("revision"), (F.coalesce("epoch", F.lit(0)) + up).alias("epoch"), F.coalesce("new_path", "path").alias("path"))


def deletions(current: DataFrame, scanned: DataFrame) -> DataFrame:
    """Stored documents whose path the scan does not have, with the epoch after deletion."""
    return current.join(scanned.select("path"), "path", "left_anti").select("doc", "path", "revision", (F.col("epoch") + 1).alias("epoch"))


def three_way(local: DataFrame, base: DataFrame, source: DataFrame) -> DataFrame:
    """(path, action) of a sync; each side: path, hash. Local text stays on a conflict."""
    sides = [d.select("path", F.col("hash").alias(n)) for d, n in ((local, "l"), (base, "b"), (source, "s"))]
    all_ = sides[0].join(sides[1], "path", "full_outer").join(sides[2], "path", "full_outer")
    l, b, s = F.col("l"), F.col("b"), F.col("s")
    action = (
        F.when(l.eqNullSafe(s), "same").when(l.eqNullSafe(b) & s.isNull(), "delete").when(l.eqNullSafe(b), F.when(l.isNull(), "add").otherwise("update")).when(s.eqNullSafe(b), "keep-local").otherwise("conflict")
    )
    return all_.select("path", action.alias("action"))


#: The bit set of forbidden runs: bits for each, and its size in powers of two at least and at most (8 MB).
RUN_BITS, RUN_SET = 16, (16, 26)


def leaks(documents: DataFrame, forbidden: DataFrame, n: int = 8, filtered: bool = True) -> DataFrame:
    """(doc, item): documents that hold a run of n words of a forbidden text, as an equi-join on the runs' hashes; must be empty to publish.

    A bit set of at most 8 MB, whatever the number of forbidden runs, spares the shuffle the runs of
    documents that are none; without it (``filtered`` false) all of them travel, and the result is the same.
    """

    def words(rows: DataFrame, key: str, text: str) -> DataFrame:
        return rows.select(key, F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("w")).where(F.size("w") >= n)

    def runs(rows: DataFrame, key: str, at: Column) -> DataFrame:
        starts = rows.select(key, "w", F.explode(at).alias("i"))
        return starts.select(key, F.md5(F.array_join(F.slice("w", F.col("i"), F.lit(n)), " ")).alias("run")).distinct()

    every = F.sequence(F.lit(1), F.size("w") - n + 1)
    own, banned, places = words(documents, "doc", "markdown"), words(forbidden, "item", "text"), every
    if filtered:
        keys = F.transform(every, lambda i: F.xxhash64(F.slice("w", i, F.lit(n))))
        hashed = banned.select(F.explode(keys).alias("h")).distinct()
        bits = min(max((hashed.count() * RUN_BITS).bit_length(), RUN_SET[0]), RUN_SET[1])
        sent = documents.sparkSession.sparkContext.broadcast(bit_set(hashed, bits))

        @F.pandas_udf("array<int>")
        def possible(h: pd.Series) -> pd.Series:
            return h.map(lambda x: np.flatnonzero(may_hold(sent.value, np.asarray(x, np.int64).view(np.uint64))) + 1)

        places = possible(keys)
    return runs(own, "doc", places).join(runs(banned, "item", every), "run").select("doc", "item").distinct()


# -- stored generations ---------------------------------------------------------


class Store:
    """Tables under generation folders; a numbered pointer file, renamed into its place last, publishes a generation.

    Any path Spark can write is fine. A pointer is never overwritten or deleted, so there is always
    a published one; a commit based on another generation than the last raises Conflict.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self) -> dict:
        folder = self._path(f"{self.root}/pointers")
        names = [str(f.getPath().getName()) for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        names = [n for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
        if not names:
            return {"generation": 0, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.root}/pointers/{max(names)}", wholetext=True).first()[0])

    def generation(self) -> int:
        return self._pointer()["generation"]

    def read(self, table: str, schema: str | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self._pointer()["tables"][table])

    def tables(self) -> list[str]:
        return sorted(self._pointer()["tables"])

    def commit(self, tables: dict[str, DataFrame], expected: int, by: dict[str, list[str]] | None = None, drop: Iterable[str] = (), written: dict[str, str] | None = None) -> int:
        """Write the given tables as the next generation, in folders by the columns named; the others are carried forward without a copy, but for dropped ones. written: tables that lie somewhere already."""
        now = self._pointer()
        if now["generation"] != expected:
            raise Conflict(f"generation {now['generation']} is published, not {expected}")
        paths = {k: v for k, v in now["tables"].items() if k not in set(drop)} | (written or {})
        folder = f"{self.root}/generation={expected + 1}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            paths[name] = f"{folder}/{name}"
            df.write.parquet(paths[name], partitionBy=(by or {}).get(name))
        fresh = self._path(f"{folder}/pointer.json")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps({"generation": expected + 1, "tables": paths}).encode()))
        out.close()
        self._fs.mkdirs(self._path(f"{self.root}/pointers"))
        self._publish(fresh, self._path(f"{self.root}/pointers/{expected + 1:012d}.json"))
        return expected + 1

    def _publish(self, fresh, place) -> None:
        """Rename without overwriting: of two writers of one generation the second fails, and a crash leaves the pointer before it."""
        sc = self.spark.sparkContext
        context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), sc._jsc.hadoopConfiguration())
        kind = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = sc._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            context.rename(fresh, place, options)
        except Exception as e:
            if self._fs.exists(place):
                raise Conflict("another commit was published meanwhile") from e
            raise


class Buckets:
    """Versioned values under keys, in buckets by a hash of the key: a write touches its keys' buckets and carries the others forward.

    Every change names the hash of the value that it replaces, or none for a new key; one that
    meets another value is refused, alone, and comes back as a row. The whole batch is one
    generation, so of two writers of one generation the second fails as a whole.
    """

    SCHEMA = "key string, value string, hash string, version long, bucket int"

    def __init__(self, store: Store, name: str = "values", buckets: int = 256):
        self.store, self.name, self.buckets = store, name, buckets

    def _paths(self) -> dict[int, str]:
        at = f"{self.name}-"
        return {int(k.removeprefix(at)): v for k, v in self.store._pointer()["tables"].items() if k.startswith(at)}

    def _read(self, paths: Iterable[str]) -> DataFrame:
        found, plain = list(paths), self.SCHEMA.rsplit(",", 1)[0]
        rows = self.store.spark.read.schema(plain).parquet(*found) if found else self.store.spark.createDataFrame([], plain)
        return rows.withColumn("bucket", self._bucket(F.col("key")))

    def _bucket(self, key: Column) -> Column:
        return (F.crc32(key.cast("binary")) % self.buckets).cast("int")

    def read(self) -> DataFrame:
        """key, value, hash, version of all live keys."""
        return self._read(self._paths().values()).drop("bucket")

    def put(self, changes: DataFrame, expected: int | None = None) -> tuple[int, DataFrame]:
        """The generation after the changes (key, value: null deletes, expected_hash: null for a key that is not there), and key, outcome, hash, version of each.

        outcome: written, unchanged, deleted, or conflict with the hash that is there. A key that
        a batch changes twice is a conflict in all its rows; a null key is one too. Nothing is
        published if nothing is written.
        """
        generation = self.store.generation() if expected is None else expected
        rows = changes.select("key", "value", "expected_hash", self._bucket(F.coalesce("key", F.lit(""))).alias("bucket"), F.count("*").over(W.partitionBy("key")).alias("_n"))
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # as many as there are buckets, at most
        paths = self._paths()
        old = self._read(paths[b] for b in touched if b in paths)
        now = old.select("key", F.col("hash").alias("_hash"), F.col("version").alias("_version"))
        met = rows.join(now, "key", "left").withColumn("_new", F.sha2(F.col("value").cast("binary"), 256))
        refused = F.col("key").isNull() | (F.col("_n") > 1) | ~F.col("_hash").eqNullSafe(F.col("expected_hash"))
        outcome = F.when(refused, "conflict").when(F.col("value").isNull(), F.when(F.col("_hash").isNull(), "unchanged").otherwise("deleted")).when(F.col("_new").eqNullSafe(F.col("_hash")), "unchanged").otherwise("written")
        judged = met.withColumn("outcome", outcome)
        moved = F.col("outcome") == "written"
        outcomes = judged.select("key", "outcome", F.when(moved, F.col("_new")).when(F.col("outcome") == "deleted", None).otherwise(F.col("_hash")).alias("hash"), (F.coalesce("_version", F.lit(0)) + moved.cast("long")).alias("version"))
        took = judged.where(F.col("outcome").isin("written", "deleted"))
        hit = sorted(r["bucket"] for r in took.select("bucket").distinct().collect())
        if not hit:
            if self.store.generation() != generation:
                raise Conflict(f"generation {self.store.generation()} is published, not {generation}")
            return generation, outcomes
        kept = old.where(F.col("bucket").isin(hit)).join(took.select("key"), "key", "left_anti")
        new = took.where(moved).select("key", "value", F.col("_new").alias("hash"), (F.coalesce("_version", F.lit(0)) + 1).cast("long").alias("version"), "bucket")
        folder = f"{self.store.root}/buckets-{uuid.uuid4().hex}"
        kept.unionByName(new).repartition("bucket").write.parquet(folder, partitionBy="bucket")
        place = self.store._path(folder)
        lie = {int(str(f.getPath().getName()).split("=")[1]): str(f.getPath()) for f in self.store._fs.listStatus(place) if "=" in str(f.getPath().getName())}
        emptied = [f"{self.name}-{b}" for b in hit if b not in lie]
        return self.store.commit({}, generation, drop=emptied, written={f"{self.name}-{b}": path for b, path in lie.items()}), outcomes
