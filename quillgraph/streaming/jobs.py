"""Embedding jobs of documents: requests, results, cancellations and removals that come in any order.

A document's events carry a generation, which another provider or its disabling raises, and a
sequence within it. The newest request, cancellation or removal rules; a result counts if it is
that request's, of the same revision, and is discarded if it is any other's. What is kept of a
document is a function of the set of its events, so a stream in any order, and a repeated event,
end where the serial run ends.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: kind is request, cancel, remove or result; failed tells of results.
EVENTS = "doc string, kind string, generation long, sequence long, revision long, failed boolean"
_OUT = "doc string, status string, generation long, sequence long, revision long, discarded long"
_STATUS = {"cancel": "cancelled", "remove": "removed"}


def job_states(events: DataFrame) -> DataFrame:
    """doc, status (ready, error, pending, cancelled, removed), generation, sequence, revision, discarded of all events so far.

    Results of documents that were never asked for are no rows, but wait in the stream. Of rulings
    with one generation and sequence, removal goes before cancellation before a request; of two
    results of one request a success goes before a failure.
    """
    key = F.struct("generation", "sequence")
    order = F.when(F.col("kind") == "remove", 2).when(F.col("kind") == "cancel", 1).otherwise(0)
    ruling = events.where("kind <> 'result'").groupBy("doc").agg(F.max_by(F.struct("kind", "generation", "sequence", "revision"), F.struct("generation", "sequence", order, "revision")).alias("r")).select("doc", "r.*")
    results = events.where("kind = 'result'").groupBy("doc", "generation", "sequence", "revision").agg(F.min(F.coalesce("failed", F.lit(False))).alias("failed"))
    own = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in ("generation", "sequence", "revision")]
    hit = (F.col("r.kind") == "request") & own[0] & own[1] & own[2]
    old = F.struct("e.generation", "e.sequence") <= F.struct("r.generation", "r.sequence")
    met = ruling.alias("r").join(results.alias("e"), "doc", "left")
    counted = met.groupBy("doc", *(F.col(f"r.{c}").alias(c) for c in ("kind", "generation", "sequence", "revision"))).agg(
        F.max(hit).alias("_hit"), F.min(F.when(hit, F.col("e.failed"))).alias("_failed"), F.count_if(F.col("e.generation").isNotNull() & ~hit & old).alias("discarded")
    )
    status = F.when(F.col("kind") == "cancel", "cancelled").when(F.col("kind") == "remove", "removed").when(~F.coalesce("_hit", F.lit(False)), "pending").when(F.col("_failed"), "error").otherwise("ready")
    return counted.select("doc", status.alias("status"), "generation", "sequence", "revision", "discarded")


class Job:
    """The state of one document: the ruling event, the results that are not older, and how many were discarded, each result once."""

    def __init__(self, text: str | None = None):
        self.ruling, self.results, self.gone = (None, {}, []) if text is None else json.loads(text)

    def export(self) -> str:
        return json.dumps([self.ruling, self.results, self.gone])

    def apply(self, kind: str, generation: int, sequence: int, revision: int, failed: bool) -> None:
        if kind == "result":
            key = json.dumps([generation, sequence, revision])
            if key not in self.gone:
                self.results[key] = bool(failed) and self.results.get(key, True)
        else:
            rank = {"remove": 2, "cancel": 1}.get(kind, 0)
            if self.ruling is None or [generation, sequence, rank, revision] > self.ruling[:4]:
                self.ruling = [generation, sequence, rank, revision, kind]
        if self.ruling:
            # Only the ruling request's own result, and those of requests that are still to come, matter further.
            now = [*self.ruling[:2], self.ruling[3]]
            for key in [k for k in self.results if json.loads(k)[:2] <= now[:2] and not (json.loads(k) == now and self.ruling[4] == "request")]:
                del self.results[key]
                self.gone.append(key)

    def row(self, doc: str) -> tuple | None:
        if not self.ruling:
            return None
        generation, sequence, _, revision, kind = self.ruling
        failed = self.results.get(json.dumps([generation, sequence, revision]))
        status = _STATUS.get(kind) or ("pending" if failed is None else "error" if failed else "ready")
        return doc, status, generation, sequence, revision, len(self.gone)


def job_stream(events: DataFrame) -> DataFrame:
    """As job_states on a stream: each batch gives the state of the documents it has events of."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        job = Job(state.get[0] if state.exists else None)
        for p in parts:
            for kind, generation, sequence, revision, failed in zip(p["kind"], p["generation"], p["sequence"], p["revision"], p["failed"], strict=True):
                job.apply(kind, int(generation), int(sequence), int(revision), failed is True or failed == 1)
        state.update((job.export(),))
        row = job.row(key[0])
        yield pd.DataFrame([row] if row else [], columns=[c.split()[0] for c in _OUT.split(", ")])

    return events.groupBy("doc").applyInPandasWithState(run, _OUT, "job string", "update", GroupStateTimeout.NoTimeout)
