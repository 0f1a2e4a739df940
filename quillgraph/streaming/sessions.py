"""Exploration sessions: idle windows, and the state machine of a session."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDLE = "30 minutes"
MORE = 40

#: Which action an event type stands for in the events table.
ACTIONS = {"view": "focus", "click": "lens", "purchase": "more", "signup": "create", "error": "refresh"}


def idle_windows(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """(user_id, session_start, events): sessions split where a user is idle; with a watermark also on a stream."""
    rows = events if watermark is None else events.withWatermark("ts", watermark)
    counted = rows.groupBy("user_id", F.session_window("ts", IDLE).alias("w")).agg(F.count("*").alias("events"))
    return counted.select("user_id", F.col("w.start").alias("session_start"), "events")


class Session:
    """focus pushes the current view on the back stack, lens and more change it, back restores it, refresh takes the live revision."""

    def __init__(self, state: dict | None = None):
        self.state = state or {"current": None, "back": [], "visited": []}

    def apply(self, action: str, value: str | float | None, revision: int = 1) -> dict:
        s = self.state
        now = s["current"]
        if action == "focus":
            if now:
                s["back"].append(now)
            s["current"] = {"focus": value, "lens": 50, "budget": MORE, "revision": revision}
            if value not in s["visited"]:
                s["visited"].append(value)
        elif action == "create":
            s.update(current=None, back=[], visited=[])
        elif now and action == "lens":
            if not 0 <= float(value) <= 100:
                raise ValueError("lens must be from 0 to 100")
            s["current"] = {**now, "lens": float(value)}
        elif now and action == "more":
            s["current"] = {**now, "budget": now["budget"] + MORE}
        elif action == "back" and s["back"]:
            s["current"] = s["back"].pop()
        elif now and action == "refresh":
            s["current"] = {**now, "revision": revision}
        return s

    def export(self) -> str:
        return json.dumps({"schemaVersion": 1, **self.state}, sort_keys=True)

    @classmethod
    def restore(cls, text: str) -> Session:
        data = json.loads(text)
        if data.pop("schemaVersion", None) != 1:
            raise ValueError("unknown session version")
        return cls(data)


_OUT = "user_id long, actions long, depth long, visited long, focus string, lens double, budget long"


def _summary(user: int, actions: int, session: Session) -> tuple:
    s, now = session.state, session.state["current"] or {}
    return user, actions, len(s["back"]), len(s["visited"]), now.get("focus"), now.get("lens"), now.get("budget")


def _value(action: str, value: float, event_id: int):
    return f"n{event_id % 50}" if action == "focus" else min(100.0, max(0.0, 0.0 if value is None or value != value else value))


def replay(events: DataFrame) -> DataFrame:
    """The state of every user's session after all its events, in their order; a user's events are one session log."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        session = Session()
        for r in pdf.sort_values(["ts", "event_id"]).itertuples():
            action = ACTIONS.get(r.event_type)
            if action:
                session.apply(action, _value(action, r.value, r.event_id))
        return pd.DataFrame([_summary(int(pdf.user_id.iloc[0]), len(pdf), session)], columns=[c.split()[0] for c in _OUT.split(", ")])

    return events.where("user_id is not null").select("user_id", "ts", "event_id", "event_type", "value").groupBy("user_id").applyInPandas(run, _OUT)


def stream(events: DataFrame) -> DataFrame:
    """As replay on a stream: the state of a session is kept between batches, and updates come out."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        actions, text = state.get if state.exists else (0, Session().export())
        session = Session.restore(text)
        for pdf in parts:
            for r in pdf.sort_values(["ts", "event_id"]).itertuples():
                actions += 1
                action = ACTIONS.get(r.event_type)
                if action:
                    session.apply(action, _value(action, r.value, r.event_id))
        state.update((actions, session.export()))
        yield pd.DataFrame([_summary(int(key[0]), actions, session)], columns=[c.split()[0] for c in _OUT.split(", ")])

    rows = events.where("user_id is not null").select("user_id", "ts", "event_id", "event_type", "value")
    return rows.groupBy("user_id").applyInPandasWithState(run, _OUT, "actions long, session string", "update", GroupStateTimeout.NoTimeout)


def evicting(events: DataFrame, watermark: str = "10 minutes", idle: str = IDLE) -> DataFrame:
    """As stream, but a session that is idle goes: once the watermark passes its last event by ``idle`` its state is removed, and a row says so (status expired).

    A user who comes back later starts anew; events later than the watermark do not count.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    columns = [c.split()[0] for c in _OUT.split(", ")]
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            actions, text, _ = state.get
            state.remove()
            yield pd.DataFrame([(*_summary(int(key[0]), actions, Session.restore(text)), "expired")], columns=[*columns, "status"])
            return
        actions, text, last = state.get if state.exists else (0, Session().export(), 0)
        session = Session.restore(text)
        for pdf in parts:
            for r in pdf.sort_values(["ts", "event_id"]).itertuples():
                at = int(r.ts.timestamp() * 1000)
                if actions and at - last > wait:
                    actions, session = 0, Session()  # the gap lies within one batch
                actions, last = actions + 1, max(last, at)
                action = ACTIONS.get(r.event_type)
                if action:
                    session.apply(action, _value(action, r.value, r.event_id))
        state.update((actions, session.export(), last))
        state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*_summary(int(key[0]), actions, session), "active")], columns=[*columns, "status"])

    rows = events.where("user_id is not null").select("user_id", "ts", "event_id", "event_type", "value").withWatermark("ts", watermark)
    return rows.groupBy("user_id").applyInPandasWithState(run, f"{_OUT}, status string", "actions long, session string, last long", "update", GroupStateTimeout.EventTimeTimeout)
