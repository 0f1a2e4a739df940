"""Incremental ingest of append-only note versions into stored generations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import Store, classify, content_hash, later_wins

DOCUMENTS = "doc string, path string, content_hash string, parser_version string, revision long, epoch long, markdown string, deleted boolean"


def merge(current: DataFrame, batch: DataFrame, parser_version: str = "1") -> DataFrame:
    """The documents after a batch (doc, path, markdown, deleted, sequence): later rows of a document win, deletions raise its epoch."""
    new = later_wins(batch, "doc", "sequence")
    live = current.where("not deleted")
    puts = new.where("not deleted")
    # Revisions survive deletion, so all stored rows take part.
    plan = classify(current.withColumn("content_hash", F.when(F.col("deleted"), "").otherwise(F.col("content_hash"))), puts, parser_version)
    text = puts.select("doc", F.col("markdown").alias("_new"))
    gone = new.where("deleted").join(live, "doc", "left_semi").select("doc", F.lit(True).alias("_gone"))
    rows = plan.join(current.select("doc", F.col("markdown").alias("_old"), F.col("deleted").alias("_was")), "doc", "left").join(text, "doc", "left").join(gone, "doc", "left")
    took = F.col("action").isin("added", "changed")
    markdown = F.when(took, F.col("_new")).otherwise(F.col("_old"))
    removed = F.coalesce("_gone", F.lit(False))
    return rows.where(F.col("_old").isNotNull() | took).select(
        "doc", "path", content_hash(markdown).alias("content_hash"), F.lit(parser_version).alias("parser_version"), "revision", (F.col("epoch") + removed.cast("long")).alias("epoch"), markdown.alias("markdown"), (removed | (~took & F.coalesce("_was", F.lit(False)))).alias("deleted")
    )


def start(source: DataFrame, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merge every micro-batch into the store's ``documents``, one writer at a time; a batch that was committed before is skipped."""
    spark = store.spark

    def run(batch: DataFrame, batch_id: int) -> None:
        generation = store.generation()
        done = store.read("batches") if "batches" in store.tables() else spark.createDataFrame([], "batch long")
        if not done.where(F.col("batch") == batch_id).isEmpty():
            return
        current = store.read("documents") if "documents" in store.tables() else spark.createDataFrame([], DOCUMENTS)
        store.commit({"documents": merge(current, batch), "batches": done.unionByName(spark.createDataFrame([(batch_id,)], "batch long"))}, generation)

    writer = source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
