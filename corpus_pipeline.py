"""The training-data pipeline: documents to token files in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; each
result is written as Parquet and read again. All but the last return the columns of
documents, whatever further columns these have.

Every stage takes null and empty texts (they are scored as such, are no near-duplicates, are
clean, have no tokens and are never taken by the mix), null ids (kept as rows of their own up
to the mix, which takes rows with an id), repeated rows (which stay or go together) and empty
tables (which give empty ones).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import op9_mix
from quillgraph.llm.op3_minhash import near_duplicates
from quillgraph.llm.op4_quality import keep_quality
from quillgraph.llm.op6_tokens import token_rows
from quillgraph.llm.op10_winnow import keep_clean
from quillgraph.llm.queries import tokenizer_file
from quillgraph.llm.shared import remove, scratch, table

#: Near-duplicates here: five-word shingles, a similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80
#: Four fifths of the tokens, by the weights of the registered mix, whole documents, none twice.
MIX = op9_mix.Recipe(op9_mix.DEFAULT.weights, 4, 5, 1, "pipeline-1", whole=True)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts 1; it is fitted on the labelled ones outside the held-out fold."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id. Of rows that repeat a doc_id all stay."""
    gone = near_duplicates(docs, SHINGLE, PERCENT).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's passages do not contaminate; one without words is clean."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes."""
    return op9_mix.keep_mix(docs, MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' rows, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_rows(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("tokens", tokens),
]

#: A trained model and a sequence of fingerprints have no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder, read again, and removed after the next.

    The last one's rows come from a checkpoint of their own, so nothing written here outlives it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove(spark, before)
        before = folder
    rows = STAGES[-1][1](spark, docs, sf_dir)
    if before:
        remove(spark, before)
    return rows
