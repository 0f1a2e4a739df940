"""Keeping derived data in step with documents, and the small lookups of the serving surfaces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import name_key
from .entities import resolutions
from .explore import read_evidence

#: Fixed patterns of the artifact audit: names that must not be published, and what no text file may hold.
PRIVATE_NAMES = r"(?i)\.(sqlite|db|map|env)$"
TEXT_NAMES = r"\.(json|js|html|css)$"
PRIVATE_TEXT = r"/Users/[^/\s]+/|/home/[^/\s]+/|sk-[A-Za-z0-9]{20,}"

LOCATOR = ("doc", "revision", "section", "start", "end")


class StaleIndex(Exception):
    """The search storage holds other revisions than the documents."""


# -- rebuild and purge ----------------------------------------------------------


def entity_signature(names: DataFrame, sections: DataFrame, aliases: DataFrame) -> str:
    """A digest of all that name resolution depends on: names (doc, name), sections (doc, section, title, depth), aliases (name, doc, section, allow_short).

    A sum of the rows' hashes, so rows need no order and meet in no task.
    """
    parts = []
    for kind, rows in (("n", names.select("doc", "name")), ("s", sections.select("doc", "section", "title", "depth")), ("a", aliases.select("name", "doc", "section", "allow_short"))):
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(kind), F.to_json(F.struct("*"), {"ignoreNullFields": "false"})), 256), 1, 15), 16, 10).cast("decimal(38,0)")
        n, total = rows.select(h.alias("h")).agg(F.count("*"), F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)"))).first()
        parts.append(f"{kind}{n}:{total}")
    return "|".join(parts)


def rebuild_scope(documents: DataFrame, cached: DataFrame, same_entities: bool) -> DataFrame:
    """(doc) of the documents whose references must be extracted again.

    documents, cached: doc, revision. With the same entity signature only new and changed ones;
    else all, since any name may now mean something else.
    """
    if not same_entities:
        return documents.select("doc")
    return documents.join(cached.select("doc", "revision"), ["doc", "revision"], "left_anti").select("doc")


def reused_references(references: DataFrame, documents: DataFrame, redone: DataFrame) -> DataFrame:
    """The cached references (source, ...) that stay: of documents that exist and are not extracted again."""
    return references.join(documents.select(F.col("doc").alias("source")), "source", "left_semi").join(redone.select(F.col("doc").alias("source")), "source", "left_anti")


def purge_vectors(records: DataFrame, documents: DataFrame) -> DataFrame:
    """records (space, doc, ...) of documents that still exist, in every space."""
    return records.join(documents.select("doc"), "doc", "left_semi").select(*records.columns)


def invalidate_vectors(states: DataFrame, documents: DataFrame) -> DataFrame:
    """states (space, doc, revision, status) after a change of documents (doc, revision): removed ones go, changed ones are pending, in every space."""
    live = documents.select("doc", F.col("revision").alias("_live"))
    joined = states.join(live, "doc")
    return joined.withColumn("status", F.when(F.col("revision") == F.col("_live"), F.col("status")).otherwise("pending")).select(*states.columns)


def drop_bad_vectors(records: DataFrame, states: DataFrame, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """Stored records (space, doc, vector) of the right length and finite, and states (space, doc, status, ready) with documents that lost some made pending."""
    fine = F.coalesce((F.size("vector") == dimensions) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    lost = records.groupBy("space", "doc").agg(F.count_if(~fine).alias("_lost"))
    after = states.join(lost, ["space", "doc"], "left")
    bad = F.coalesce("_lost", F.lit(0))
    after = after.withColumn("status", F.when(bad > 0, "pending").otherwise(F.col("status"))).withColumn("ready", F.greatest(F.lit(0), F.col("ready") - bad)).select(*states.columns)
    return records.where(fine), after


def change_scope(documents: DataFrame, archive: DataFrame, kept: Column) -> tuple[DataFrame, DataFrame]:
    """Documents and archive (same columns, with path) under new rules: excluded ones are archived, archived ones that the rules keep come back.

    kept: a condition on path, such as vault.kept_by. A document that is back with the same doc
    as a live one stays archived no longer, and the live one wins.
    """
    all_ = documents.withColumn("_live", F.lit(1)).unionByName(archive.withColumn("_live", F.lit(0)))
    first = all_.withColumn("_r", F.row_number().over(W.partitionBy("doc").orderBy(F.desc("_live")))).where("_r = 1").drop("_r", "_live")
    inside = F.coalesce(kept, F.lit(False))
    return first.where(inside), first.where(~inside)


# -- lookups --------------------------------------------------------------------


def live_hits(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """hits (doc, revision, ...) as they are; StaleIndex if any is of another revision than its document (doc, revision)."""
    if not hits.join(documents.select("doc", "revision"), ["doc", "revision"], "left_anti").isEmpty():
        raise StaleIndex("search storage changed; build the index again")
    return hits


def _innermost(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Locators with the deepest section open at their start that reaches their end; rows come by document and place, sections first."""
        doc, open_ = None, []
        for b in batches:
            rows, found = [], []
            columns = (b.column(c).to_pylist() for c in ("_doc", "_at", "_to", "_depth", "_section", "_kind"))
            for i, (own, at, to, depth, section, kind) in enumerate(zip(*columns, strict=True)):
                if own != doc:
                    doc, open_ = own, []
                open_ = [s for s in open_ if s[3] >= at]
                if kind == 0:
                    open_.append((depth, at, section, to))
                else:
                    rows.append(i)
                    found.append(max(((d, s, x) for d, s, x, e in open_ if e >= to), default=(0, 0, None))[2])
            kept = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names), pa.array(found, pa.string())], [*names, "section"])

    return run


def deepest_sections(locators: DataFrame, sections: DataFrame) -> DataFrame:
    """locators (doc, start, end, ...) with section: the deepest one that holds the span, null if none does.

    sections: doc, section, s, e, depth. One sort of both by document and place; a document's
    locators pass the sections that are open where they begin, few as sections nest.
    """
    keep = [c for c in locators.columns if c != "section"]
    null = lambda c: F.lit(None).cast(locators.schema[c].dataType).alias(c)
    place = [F.col("start").cast("long").alias("_at"), F.col("end").cast("long").alias("_to"), F.lit(None).cast("int").alias("_depth"), F.lit(None).cast("string").alias("_section"), F.lit(1).alias("_kind")]
    own = locators.select(F.col("doc").alias("_doc"), *place, *keep)
    opens = sections.select(F.col("doc").alias("_doc"), F.col("s").cast("long").alias("_at"), F.col("e").cast("long").alias("_to"), F.col("depth").cast("int").alias("_depth"), F.col("section").alias("_section"), F.lit(0).alias("_kind"), *map(null, keep))
    fields = ", ".join(f"`{c}` {locators.schema[c].dataType.simpleString()}" for c in keep)
    return own.unionByName(opens).repartition("_doc").sortWithinPartitions("_doc", "_at", "_kind", "_depth").mapInArrow(_innermost(keep), f"{fields}, section string")


def allowed(locators: DataFrame, documents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The locators of documents in scope (doc), and with ``known`` those that are exactly among its locators."""
    inside = locators.join(documents.select("doc"), "doc", "left_semi").select(*locators.columns)
    return inside if known is None else inside.join(known.select(*LOCATOR), list(LOCATOR), "left_semi").select(*locators.columns)


def distinct_locators(evidence: DataFrame) -> DataFrame:
    """(relation, locator columns): each place that speaks for a relation once, whatever signals name it."""
    return evidence.select("relation", *LOCATOR).distinct()


def evidence_report(evidence: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """(relation, kind, locator columns, status, text, excerpt): what each signal (relation, kind, locator) rests on, read from the documents."""
    places = evidence.select(*LOCATOR).distinct()
    return evidence.join(read_evidence(places, documents, sections), list(LOCATOR)).select("relation", "kind", *LOCATOR, "status", "text", "excerpt")


def resolve_inputs(inputs: DataFrame, documents: DataFrame, entities: DataFrame) -> DataFrame:
    """(input, status, doc) of what a user typed: paired quotes go, an id is taken as such, anything else is a name.

    documents: doc; entities: as of entities.dictionary. status: resolved, ambiguous, suppressed or missing.
    """
    value = F.regexp_replace("input", r"""^(["'])(.*)\1$""", "$2")
    rows = inputs.select("input", value.alias("_value")).withColumn("_key", name_key(F.col("_value")))
    ids = documents.select(F.col("doc").alias("_value"), F.col("doc").alias("_doc")).distinct()
    found = resolutions(entities).select(F.col("name_key").alias("_key"), F.col("status").alias("_status"), "target")
    rows = rows.join(ids, "_value", "left").join(found, "_key", "left")
    return rows.select("input", F.when(F.col("_doc").isNotNull(), "resolved").otherwise(F.coalesce("_status", F.lit("missing"))).alias("status"), F.coalesce("_doc", "target").alias("doc"))


def hover(edges: DataFrame, node: str) -> DataFrame:
    """edges (node_a, node_b, ...) with muted: whether an edge does not touch the node under the pointer."""
    return edges.withColumn("muted", (F.col("node_a") != node) & (F.col("node_b") != node))


def hover_nodes(edges: DataFrame, node: str) -> DataFrame:
    """(node): the node and all one step from it."""
    near = edges.where((F.col("node_a") == node) | (F.col("node_b") == node))
    return near.select(F.explode(F.array("node_a", "node_b", F.lit(node))).alias("node")).unionByName(edges.sparkSession.createDataFrame([(node,)], "node string")).distinct()


def frozen_coverage(contributions: DataFrame) -> DataFrame:
    """(status, ready_units, total_units) of precomputed signals: contributions (valid, unit); different units, those of valid signals being ready."""
    counted = contributions.agg(F.count_distinct(F.when(F.col("valid"), F.col("unit"))).alias("ready_units"), F.count_distinct("unit").alias("total_units"))
    return counted.select(F.when(F.col("ready_units") > 0, "ready").otherwise("stale").alias("status"), "ready_units", "total_units")


def artifact_faults(spark: SparkSession, root: str, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """(path, fault) of files under root that must not be published; empty when it is clean.

    By name: databases, maps and environment files; by text: local paths, keys and the forbidden strings.
    Empty files are not listed by the source and hold nothing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = files.where(F.col("path").rlike(PRIVATE_NAMES)).select("path", F.lit("private file").alias("fault"))
    texts = files.where(F.col("path").rlike(TEXT_NAMES)).select("path", F.col("content").cast("string").alias("text"))
    held = texts.select("path", F.explode(F.array_compact(F.array(F.when(F.col("text").rlike(PRIVATE_TEXT), "local path or key"), *(F.when(F.col("text").contains(x), f"forbidden text {i}") for i, x in enumerate(forbidden))))).alias("fault"))
    return named.unionByName(held)


class MemoryStore:
    """The interface of ingest.Store over tables that the session keeps: a commit copies, so what a table was made of may change.

    A copy is a checkpoint where the session has a folder for these, else it is held by the executors.
    """

    def __init__(self, tables: dict[str, DataFrame] | None = None):
        self._tables, self._generation = dict(tables or {}), 0

    def generation(self) -> int:
        return self._generation

    def read(self, table: str) -> DataFrame:
        return self._tables[table]

    def tables(self) -> list[str]:
        return sorted(self._tables)

    @staticmethod
    def _copied(df: DataFrame) -> DataFrame:
        if df.sparkSession.sparkContext.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", ""):
            return df.checkpoint()
        held = df.persist()
        held.count()
        return held

    def commit(self, tables: dict[str, DataFrame], expected: int) -> int:
        from .ingest import Conflict

        if expected != self._generation:
            raise Conflict(f"generation {self._generation} is published, not {expected}")
        self._tables |= {name: self._copied(df) for name, df in tables.items()}
        self._generation += 1
        return self._generation
