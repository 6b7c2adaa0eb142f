"""Tracking as a stream: one state per session, exact about duplicates, order, lateness and gaps.

Rows are (session, seq, end, received, digest, p, problem); a row without ``p`` is an abstention and says why in
``problem``. Each row gets an outcome: accepted, duplicate (nothing changes) or rejected with its reason. A duplicate
gets the answer of the row it repeats again, with that row's transition in ``repeats``, so that ``kind`` tells each once.
The batch counterpart is ``echoline.operators.tracking``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from echoline.functions import config

ROWS = "session string, seq long, end double, received double, digest string, p double, problem string"
OUTCOMES = "session string, seq long, outcome string, reason string, kind string, event long, observed long, high long, interrupted boolean, repeats string"
STATE = "seq long, end double, received double, digest string, degraded boolean, rising long, falling long, active boolean, event long, observed long, high long, current long, interrupted boolean, persisted boolean, finished boolean, said string, inside boolean"
FIELDS = [x.split(" ")[0] for x in STATE.split(", ")]
START = (-1, None, None, None, False, 0, 0, False, 0, 0, 0, 0, False, False, False, None, False)
MAX_GAP, AHEAD, CADENCE = 2.0, 0.25, 0.01
#: The ``problem`` of a row that ends its session: an open event stops with its coverage interrupted.
END_OF_SESSION = "end of session"


def refused(s: dict, r) -> str | None:
    """Why a row can't be taken, or None; "duplicate" for an exact repetition of the last row."""
    if r.seq == s["seq"]:
        return "duplicate" if r.end == s["end"] and r.digest == s["digest"] else "conflict"
    if s["finished"]:
        return "session has ended"
    if r.seq < s["seq"]:
        return "old"
    if r.end > r.received + AHEAD:
        return "future"
    if r.received - r.end > MAX_GAP:
        return "stale"
    if s["end"] is not None and abs((r.end - s["end"]) - (r.seq - s["seq"])) > CADENCE:
        return "cadence"
    if pd.isna(r.p):
        return None if r.problem else "abstention without a reason"
    return None if 0 <= r.p <= 1 else "score"


def advance(s: dict, r) -> str | None:
    """Move the state by an accepted row; the kind of transition, or None."""
    problem = pd.isna(r.p)
    if problem and r.problem == END_OF_SESSION:
        stopped = s["active"]
        s.update(seq=r.seq, end=r.end, received=r.received, digest=r.digest, finished=True, active=False, interrupted=s["interrupted"] or stopped)
        return "stopped" if stopped else None
    late = s["received"] is not None and r.received - s["received"] > MAX_GAP
    if r.seq > s["seq"] + 1 or s["degraded"] or late or problem:
        s["rising"] = s["falling"] = s["current"] = 0
        s["interrupted"] |= s["active"]
    s.update(seq=r.seq, end=r.end, received=r.received, digest=r.digest, degraded=problem)
    if problem:
        return None
    high = r.p >= config.OPEN_AT
    if not s["active"]:
        s["rising"] = s["rising"] + 1 if high else 0
        if s["rising"] < config.OPEN_RUN:
            return None
        run = s["rising"]
        s.update(active=True, event=s["event"] + 1, rising=0, falling=0, observed=run, high=run, current=run, interrupted=False, persisted=False)
        return "opened"
    s["observed"] += 1
    s["high"] += high
    s["current"] = s["current"] + 1 if high else 0
    s["falling"] = s["falling"] + 1 if r.p <= config.CLOSE_AT else 0
    if s["falling"] >= config.CLOSE_RUN:
        s.update(active=False, falling=0)
        return "ended"
    if s["current"] > config.PERSIST_OVER and not s["persisted"]:
        s["persisted"] = True
        return "persistent"
    return None


def answer(s: dict) -> list:
    """Event, observed and high windows and interruption after the last accepted row; nulls outside of an event."""
    return [s["event"], s["observed"], s["high"], s["interrupted"]] if s["inside"] else [None] * 4


def _session(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """State function; rows of a trigger are taken in the order they were received."""
    s = dict(zip(FIELDS, state.get if state.exists else START, strict=True))
    out = []
    for r in pd.concat(list(batches)).sort_values(["received", "seq"], kind="stable").itertuples():
        reason = refused(s, r)
        if reason == "duplicate":
            out.append((key[0], r.seq, "duplicate", None, None, *answer(s), s["said"]))
        elif reason:
            out.append((key[0], r.seq, "rejected", reason, None, *[None] * 5))
        else:
            kind = s["said"] = advance(s, r)
            s["inside"] = s["active"] or kind in ("ended", "stopped")
            out.append((key[0], r.seq, "accepted", None, kind, *answer(s), None))
    state.update(tuple(s[f] for f in FIELDS))
    frame = pd.DataFrame(out, columns=[x.split(" ")[0] for x in OUTCOMES.split(", ")])
    yield frame.astype({c: "Int64" for c in ("event", "observed", "high")})


def track_stream(rows: DataFrame) -> DataFrame:
    """Outcomes of a stream of ``ROWS``; state lives in the query's checkpoint and survives restarts."""
    return rows.groupBy("session").applyInPandasWithState(_session, OUTCOMES, STATE, "append", "NoTimeout")


def lock_policy(spark: SparkSession, path: str) -> None:
    """Write the tracking policy to ``path`` once; later runs over the same state must have the same policy."""
    names = ("OPEN_AT", "OPEN_RUN", "CLOSE_AT", "CLOSE_RUN", "PERSIST_OVER", "HISTORY")
    policy = json.dumps({n: getattr(config, n) for n in names} | {"MAX_GAP": MAX_GAP, "AHEAD": AHEAD, "CADENCE": CADENCE}, sort_keys=True)
    try:
        known = spark.read.text(path, wholetext=True).first()[0].strip()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        spark.createDataFrame([(policy,)], "value string").coalesce(1).write.mode("errorifexists").text(path)
        return
    if known != policy:
        raise ValueError("the policy differs from the one of this state; use a new checkpoint")


def outbox(outcomes: DataFrame, path: str):
    """``foreachBatch`` sink: transitions as Parquet, one folder per batch, so that a repeated batch replaces itself.

    Nothing is sent: rows carry ``sent`` = false.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.filter("kind is not null").selectExpr("session", "event", "kind", "seq", "false AS sent").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return outcomes.writeStream.foreachBatch(write).outputMode("append")
