"""Incidents as a stream of commands per source: persistence, one dispatch, explicit retries, resolution.

Commands are (source, at, kind, ok, detail), taken in the order of ``at``: ``start`` and ``resolve`` by a user, ``tick``
by a clock, ``delivered`` with the outcome of a dispatch (``ok`` null: unknown), ``retry``, and ``restart`` after a
crash. Nothing is sent from here: a ``dispatch`` row asks a sink to do so, at most once per attempt.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERSISTENCE = 30.0
COMMANDS = "source string, at double, kind string, ok boolean, detail string"
EVENTS = "source string, incident long, at double, event string, status string, delivery string, attempts long, detail string"
STATE = "incident long, started double, status string, delivery string, attempts long, retrying boolean, resolved double"
FIELDS = [x.split(" ")[0] for x in STATE.split(", ")]
START = (0, None, "idle", "not_dispatched", 0, False, None)


def step(s: dict, at: float, kind: str, ok: bool | None = None, detail: str | None = None, persistence: float = PERSISTENCE) -> Iterator[tuple[float, str, str | None]]:
    """Apply one command to the state of a source; yields (time, event, detail)."""
    open_ = s["status"] != "idle"
    if kind == "start" and not open_:
        s.update(incident=s["incident"] + 1, started=at, status="pending", delivery="not_dispatched", attempts=0, retrying=False, resolved=None)
        yield at, "anomaly_started", detail
    elif kind == "tick" and open_:
        again = s["status"] == "failed" and s["retrying"]
        if not again:
            if s["status"] != "pending" or at - s["started"] < persistence:
                return
            yield s["started"] + persistence, "persistence_confirmed", None
        s.update(status="dispatching", delivery="dispatching", attempts=s["attempts"] + 1, retrying=False)
        yield at, "dispatch", None
    elif kind in ("delivered", "restart") and s["status"] == "dispatching":
        sent = kind == "delivered" and ok is True
        known = kind == "delivered" and ok is False
        s.update(status="sent" if sent else "failed", delivery="sent" if sent else "failed" if known else "unknown")
        yield at, "alert_sent" if sent else "alert_failed", detail
        if s["resolved"] is not None:
            s["status"] = "idle"
            yield s["resolved"], "resolved", None
    elif kind == "retry" and s["status"] == "failed" and s["delivery"] == "failed":
        # Never after an unknown outcome: the message may have arrived.
        s["retrying"] = True
        yield at, "retry_requested", None
    elif kind == "resolve" and open_:
        s["resolved"] = at
        if s["status"] != "dispatching":
            s["status"] = "idle"
            yield at, "resolved", None


def _told(source: str, s: dict, commands: pd.DataFrame) -> pd.DataFrame:
    out = []
    for c in commands.sort_values("at", kind="stable").itertuples():
        for at, event, detail in step(s, c.at, c.kind, None if pd.isna(c.ok) else bool(c.ok), c.detail):
            out.append((source, s["incident"], at, event, "resolved" if event == "resolved" else s["status"], s["delivery"], s["attempts"], detail))
    return pd.DataFrame(out, columns=[x.split(" ")[0] for x in EVENTS.split(", ")])


def _source(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    s = dict(zip(FIELDS, state.get if state.exists else START, strict=True))
    out = _told(key[0], s, pd.concat(list(batches)))
    state.update(tuple(s[f] for f in FIELDS))
    yield out


def incident_stream(commands: DataFrame) -> DataFrame:
    """Events of a stream of ``COMMANDS``; at most one open incident per source."""
    return commands.groupBy("source").applyInPandasWithState(_source, EVENTS, STATE, "append", "NoTimeout")


def incident_log(commands: DataFrame) -> DataFrame:
    """The same events of a finished table of commands; a source's commands fit a task."""
    return commands.groupBy("source").applyInPandas(lambda key, pdf: _told(key[0], dict(zip(FIELDS, START, strict=True)), pdf), EVENTS)


def history(events: DataFrame, keep: int = 50) -> DataFrame:
    """The last ``keep`` resolved incidents of each source, newest first, with their events in order."""
    closed = events.filter("event = 'resolved'").select("source", "incident", F.col("at").alias("resolved_at"))
    latest = closed.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("incident")))).filter(F.col("k") <= keep)
    told = events.join(latest, ["source", "incident"])
    return told.groupBy("source", "incident", "resolved_at").agg(F.sort_array(F.collect_list(F.struct("at", "event", "detail"))).alias("events"), F.max("attempts").alias("attempts"))


def counters(events: DataFrame) -> DataFrame:
    """Per kind of event how often it occurred, over how many sources, and when last."""
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), F.max("at").alias("latest"))


def due(started: DataFrame, now, persistence: float = PERSISTENCE) -> DataFrame:
    """Pending incidents (source, incident, started_at) that have lasted long enough at ``now``, in a batch."""
    return started.filter(F.col("started_at") + persistence <= now).withColumn("confirmed_at", F.col("started_at") + persistence)


def health(last_seen: DataFrame, now, max_gap: float = 2.0) -> DataFrame:
    """Add ``health`` to sessions (session, received): stale once nothing came for longer than ``max_gap``."""
    return last_seen.withColumn("health", F.when(F.col("received").isNull() | (F.lit(now) - F.col("received") > max_gap), "stale").otherwise("current"))
