"""Incremental embedding: a provider, reuse by content, guarded publication."""

from __future__ import annotations

import hashlib
import itertools
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import current_results, reuse_split, vector_status


class Provider(Protocol):
    """What embeds texts; it is sent to the tasks, so it must pickle. Retryable failures raise TimeoutError or ConnectionError."""

    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashProvider:
    """A deterministic stand-in: a vector from the text's digest, of length 1."""

    def __init__(self, dimensions: int = 8):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = [b - 127.5 for b in hashlib.sha512(t.encode()).digest()[: self.dimensions]]
            size = sum(x * x for x in raw) ** 0.5
            out.append([x / size for x in raw])
        return out


def with_retry(call: Callable[[], list[list[float]]], retries: int, delay: float) -> list[list[float]]:
    """Only retryable failures are tried again, after delays that double up to a minute."""
    for n in range(retries + 1):
        try:
            return call()
        except (TimeoutError, ConnectionError):
            if n == retries:
                raise
            time.sleep(min(60.0, delay * 2**n))
    raise AssertionError


def _embedded(provider: Provider, texts: list[str], retries: int, delay: float) -> list[tuple[list[float] | None, str | None]]:
    """Vector and error of each text of one document's batch; if the batch fails, each text is tried alone, so a bad one fails itself only."""
    try:
        got = with_retry(lambda: provider.embed(texts), retries, delay)
        if len(got) != len(texts):
            raise ValueError("the provider returned another number of vectors")
        return [(v, None) for v in got]
    except Exception as e:  # the rows say so
        if len(texts) == 1:
            return [(None, str(e) or type(e).__name__)]
    return [row for t in texts for row in _embedded(provider, [t], retries, delay)]


def encode(units: DataFrame, provider: Provider, batch: int = 4, retries: int = 2, delay: float = 0.1) -> DataFrame:
    """units (doc, unit, text, ...) with vector and error. A batch never spans documents.

    Units are sorted where they lie, so nothing is shuffled; however they lie, each has the same
    outcome, as a failed batch is taken apart. A null doc is a document, a null text the empty one.
    """
    names = units.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts = p["text"].fillna("").tolist()
            found: list[tuple[list[float] | None, str | None]] = []
            for _, own in itertools.groupby(range(len(p)), lambda i, docs=p["doc"].tolist(): docs[i]):
                rows = list(own)
                for k in range(0, len(rows), batch):
                    found += _embedded(provider, [texts[i] for i in rows[k : k + batch]], retries, delay)
            yield p.assign(vector=[v for v, _ in found], error=[e for _, e in found])[[*names, "vector", "error"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields)
    return units.sortWithinPartitions("doc", "unit").mapInPandas(run, f"{fields}, vector array<double>, error string")


def index(units: DataFrame, stored: DataFrame, live: DataFrame, provider: Provider, normalized: bool = True) -> DataFrame:
    """The units' vectors, with action reuse, encode or discard, and an error where encoding failed.

    units: doc, unit, content_hash, text, revision, sequence. stored: doc, content_hash, vector;
    known content is not encoded again. live: doc, revision; results that are not of the live
    revision and the latest sequence are discarded, and not encoded either.
    """
    marked = current_results(units, live)
    split = reuse_split(stored, marked.where("accepted"))
    known = stored.dropDuplicates(["doc", "content_hash"]).select("doc", "content_hash", "vector")
    reused = split.where("action = 'reuse'").join(known, ["doc", "content_hash"]).withColumn("error", F.lit(None).cast("string"))
    fresh = encode(split.where("action = 'encode'"), provider)
    status = vector_status(F.col("vector"), provider.dimensions, normalized)
    fresh = fresh.withColumn("error", F.coalesce("error", F.when(status != "ok", status)))
    late = marked.where(~F.col("accepted")).withColumn("action", F.lit("discard")).withColumn("vector", F.lit(None).cast("array<double>")).withColumn("error", F.lit(None).cast("string"))
    return reused.unionByName(fresh).unionByName(late).drop("accepted")
