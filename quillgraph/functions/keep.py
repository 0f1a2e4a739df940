"""Rows that several steps read, computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoints if the session has a folder for them, else held by the executors, in memory or on disk."""
    if df.sparkSession.sparkContext.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", ""):
        return df.checkpoint()
    held = df.persist()
    held.count()
    return held
