"""Opening a vault again: a stored manifest met with a scan, and what each difference raises.

The manifest knows the documents of the last save (id, path, revision, content hash), the revision
and validity epoch of every id there ever was, two counters, and signatures of what derived data
depends on besides the texts: the parser, the scoring policy and the user's declarations. Opening
is one full outer join of manifest and scan by path; nothing is written until ``save``, which fails
if another writer saved meanwhile (ingest.Conflict).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import Store

_SCHEMAS = {
    "documents": "doc string, path string, revision long, content_hash string",
    "revisions": "doc string, revision long, epoch long",
    "meta": "root string, index_revision long, policy_revision long, parser string, policy string, declarations string",
}


def declarations_digest(*tables: DataFrame) -> str:
    """A digest of the user's declarations (aliases, relations, ...): of their rows, in no order, by sums of hashes."""
    parts = []
    for rows in tables:
        text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
        sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), text).cast("decimal(38,0)")), F.lit(0)).cast("string") for seed in (1, 2)]
        parts.append(":".join(map(str, rows.agg(F.count("*"), *sums).first())))
    return "|".join(parts)


@dataclass
class Opened:
    """A vault as it is now. documents: doc, path, markdown, revision, content_hash; epochs: doc, revision, epoch of all ids ever;
    changes: doc, path, action (added, changed, unchanged, missing)."""

    store: Store
    generation: int
    meta: tuple
    documents: DataFrame
    epochs: DataFrame
    changes: DataFrame

    @property
    def index_revision(self) -> int:
        return self.meta[1]

    @property
    def policy_revision(self) -> int:
        return self.meta[2]

    def save(self) -> int:
        """Publish the manifest; gives its generation."""
        spark = self.documents.sparkSession
        tables = {"documents": self.documents.select("doc", "path", "revision", "content_hash"), "revisions": self.epochs, "meta": spark.createDataFrame([self.meta], _SCHEMAS["meta"])}
        return self.store.commit(tables, self.generation)


def _plain(path: str) -> str:
    return re.sub(r"^[a-z]+:/+", "/", path.rstrip("/"))


def open_vault(spark: SparkSession, root: str, state: str, scanned: DataFrame, parser: str, policy: str, declarations: str = "") -> Opened:
    """The vault at ``root`` whose manifest is kept under ``state``, with its files as scanned (path, markdown), one row a path.

    An unchanged file keeps id and revision; a changed one keeps its id, and revision and epoch
    rise; a new path gets a new id, also where a file was deleted there before; a missing one's
    epoch rises. The index revision rises by one for each of: another parser or policy, other
    declarations (which raise the policy revision too), missing files, new or changed ones. A state
    folder inside the vault, or a manifest of another vault, is a ValueError. The folder is empty
    the first time; that raises nothing but the new files.
    """
    if _plain(state) == _plain(root) or _plain(state).startswith(_plain(root) + "/"):
        raise ValueError("the state folder must be outside the vault")
    store = Store(spark, state)
    generation = store.generation()
    stored = {k: store.read(k, s) if generation else spark.createDataFrame([], s) for k, s in _SCHEMAS.items()}
    last = stored["meta"].first()
    if last and last["root"] != _plain(root):
        raise ValueError("the manifest belongs to another vault")
    index, policies = (last["index_revision"], last["policy_revision"]) if last else (0, 0)
    if last and (last["parser"] != parser or last["policy"] != policy):
        index += 1
    if last and last["declarations"] != declarations:
        index, policies = index + 1, policies + 1
    was = stored["documents"].select("path", F.col("doc").alias("_doc"), F.col("content_hash").alias("_hash"))
    now = scanned.select("path", "markdown", F.sha2(F.col("markdown").cast("binary"), 256).alias("content_hash"))
    merged = was.join(now, "path", "full_outer")
    fresh = F.concat(F.lit("v"), F.substring(F.sha2(F.concat_ws("\x00", F.lit(_plain(root)), F.col("path"), F.lit(str(generation))).cast("binary"), 256), 1, 32))
    action = F.when(F.col("content_hash").isNull(), "missing").when(F.col("_doc").isNull(), "added").when(F.col("_hash") == F.col("content_hash"), "unchanged").otherwise("changed")
    marked = merged.select(F.coalesce("_doc", fresh).alias("doc"), "path", "markdown", "content_hash", action.alias("action"))
    known = stored["revisions"]
    rise = F.col("action").isin("added", "changed")
    all_ = known.join(marked.select("doc", "action"), "doc", "full_outer")
    epochs = all_.select(
        "doc", (F.coalesce("revision", F.lit(0)) + F.coalesce(rise, F.lit(False)).cast("long")).alias("revision"),
        (F.coalesce("epoch", F.lit(0)) + F.coalesce(rise | (F.col("action") == "missing"), F.lit(False)).cast("long")).alias("epoch"),
    )
    seen = marked.agg(F.count_if(F.col("action") == "missing").alias("missing"), F.count_if(rise).alias("risen")).first()
    index += (seen["missing"] > 0) + (seen["risen"] > 0)
    documents = marked.where("action <> 'missing'").join(epochs.select("doc", "revision"), "doc").select("doc", "path", "markdown", "revision", "content_hash")
    return Opened(store, generation, (_plain(root), index, policies, parser, policy, declarations), documents, epochs, marked.select("doc", "path", "action"))
