"""Streams with state: embedding jobs in any order, and sessions that expire."""

import json
import os
import random

from pyspark.sql import functions as F

from quillgraph.streaming import jobs, sessions


def serial(events):
    """The state after the events in the order of their requests, results after what they answer."""
    out = {}
    for doc in {e[0] for e in events}:
        own = {e for e in events if e[0] == doc}
        rules = sorted((e for e in own if e[1] != "result"), key=lambda e: (e[2], e[3], {"remove": 2, "cancel": 1}.get(e[1], 0), e[4]))
        if not rules:
            continue
        _, kind, g, s, r, _ = rules[-1]
        answers = [e[5] for e in own if e[1] == "result" and e[2:5] == (g, s, r)] if kind == "request" else []
        status = {"cancel": "cancelled", "remove": "removed"}.get(kind) or ("pending" if not answers else "error" if all(answers) else "ready")
        late = {e[2:5] for e in own if e[1] == "result" and e[2:4] <= (g, s) and not (kind == "request" and e[2:5] == (g, s, r))}
        out[doc] = (status, g, s, r, len(late))
    return out


def log(rng, n):
    out = []
    for k in range(n):
        doc, g, s, r = f"d{rng.randrange(4)}", rng.choice([1, 1, 1, 2]), rng.randrange(6), rng.randrange(3)
        kind = rng.choice(["request", "request", "result", "result", "result", "cancel", "remove"])
        out.append((doc, kind, g, s, r, kind == "result" and rng.random() < 0.4))
    return out


def test_any_order_ends_in_the_serial_state():
    rng = random.Random(3)
    for _ in range(300):
        events = log(rng, rng.randint(1, 30))
        want = serial(events)
        for _ in range(3):
            rng.shuffle(events)
            states = {}
            for e in events + events[: len(events) // 3]:
                state = jobs.Job(states.get(e[0]))
                state.apply(*e[1:])
                states[e[0]] = state.export()
            got = {d: jobs.Job(t).row(d) for d, t in states.items()}
            assert {d: r[1:] for d, r in got.items() if r} == want


def test_stream_and_batch_agree(spark, tmp_path):
    rng = random.Random(8)
    events = log(rng, 60)
    rows = spark.createDataFrame(events, jobs.EVENTS)
    want = serial(events)
    assert {r.doc: tuple(r)[1:] for r in jobs.job_states(rows).collect()} == want
    rng.shuffle(events)
    src = tmp_path / "in"
    os.makedirs(src)
    got = {}
    for k in range(0, 60, 20):
        (src / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("doc", "kind", "generation", "sequence", "revision", "failed"), e, strict=True))) for e in events[k : k + 20]))
        stream = jobs.job_stream(spark.readStream.schema(jobs.EVENTS).json(str(src)))
        stream.writeStream.outputMode("update").foreachBatch(lambda b, _: got.update({r.doc: tuple(r)[1:] for r in b.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert got == want


def test_idle_sessions_expire_after_a_restart(spark, tmp_path):
    schema = "event_id long, user_id long, t long, event_type string, value double"
    src, seen = tmp_path / "in", []
    os.makedirs(src)

    def put(name, rows):
        (src / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("event_id", "user_id", "t", "event_type", "value"), r, strict=True))) for r in rows))
        events = spark.readStream.schema(schema).json(str(src)).withColumn("ts", F.timestamp_seconds(F.col("t") + 100_000))
        out = []
        q = sessions.evicting(events, "1 minute").writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append({(r.user_id, r.status): r.actions for r in out})
        return seen[-1]

    assert put("1", [(1, 1, 0, "view", 1.0), (2, 1, 60, "click", 80.0), (3, 2, 100, "view", 1.0)]) == {(1, "active"): 2, (2, "active"): 1}
    two = put("2", [(4, 2, 1700, "view", 1.0), (5, 3, 2000, "view", 1.0)])  # user 1 is idle since 60 s: 31 minutes and more with the watermark at 1940 s
    assert two[2, "active"] == 2 and two[3, "active"] == 1 and two.get((1, "expired")) == 2
    three = put("3", [(6, 1, 2100, "view", 1.0)])
    assert three[1, "active"] == 1 and (2, "expired") not in three
