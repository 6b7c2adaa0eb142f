"""Clocks in the state: sessions that go stale, restarts that degrade them, incidents that are dispatched once.

Both processors keep the id of the run (``boot``) that wrote a state last. Processing-time timers live in the state store
with it, so a timer that was set before a crash fires after it, under another ``boot``. They need the RocksDB state store:
``STORE`` names the setting.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from echoline.streaming import incidents, tracker

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Seconds after which a session without rows is stale, a dispatch without an answer is given up, and a session that is no longer written is forgotten.
STALE_AFTER, WATCH, FORGET = tracker.MAX_GAP, 60.0, 24 * 3600.0
RESTARTED = "restarted during dispatch; delivery unknown, not retried"
UNANSWERED = "no answer to the dispatch; delivery unknown, not retried"
SESSIONS = f"{tracker.OUTCOMES}, health string, boot string"
SESSION_STATE = f"{tracker.STATE}, health string, boot string"


def _columns(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


class _Clocked(StatefulProcessor):
    """At most one timer per key, milliseconds on the cluster's clock."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema, None if self.keep is None else int(self.keep * 1000))

    def _set(self, at: float | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(int(at))

    def close(self) -> None:
        pass


class Sessions(_Clocked):
    """The tracker of ``tracker.track_stream`` with health: ``fresh``, ``degraded``, ``stale`` or ``ended``.

    A session that gets no row for ``stale_after`` seconds is told as stale by its timer. The first row or timer under
    another ``boot`` degrades it: runs of high windows start again and an open event's coverage counts as interrupted.
    """

    schema = SESSION_STATE

    def __init__(self, boot: str, stale_after: float = STALE_AFTER, keep: float | None = FORGET):
        self.boot, self.stale_after, self.keep = boot, stale_after, keep

    def _load(self) -> dict:
        start = (*tracker.START, "starting", self.boot)
        return dict(zip(_columns(SESSION_STATE), self.state.get() if self.state.exists() else start, strict=True))

    def _save(self, s: dict) -> None:
        self.state.update(tuple(s[f] for f in _columns(SESSION_STATE)))

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=_columns(SESSIONS))
        return frame.astype({c: "Int64" for c in ("seq", "event", "observed", "high")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, out = self._load(), []
        for r in pd.concat(list(rows)).sort_values(["received", "seq"], kind="stable").itertuples():
            reason = tracker.refused(s, r)
            if reason == "duplicate":
                out.append((key[0], r.seq, "duplicate", None, None, *tracker.answer(s), s["said"], s["health"], self.boot))
            elif reason:
                out.append((key[0], r.seq, "rejected", reason, None, *[None] * 5, s["health"], self.boot))
            else:
                s["degraded"] |= s["boot"] != self.boot
                kind = s["said"] = tracker.advance(s, r)
                s["inside"] = s["active"] or kind in ("ended", "stopped")
                s.update(boot=self.boot, health="ended" if s["finished"] else "degraded" if s["degraded"] else "fresh")
                out.append((key[0], r.seq, "accepted", None, kind, *tracker.answer(s), None, s["health"], self.boot))
        self._save(s)
        self._set(None if s["finished"] else timerValues.getCurrentProcessingTimeInMs() + 1000 * self.stale_after)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        if s["finished"]:
            return
        s["health"] = "stale" if s["boot"] == self.boot else "degraded"
        s["degraded"] = True
        self._save(s)
        yield self._frame([(key[0], s["seq"], "timer", "restart" if s["health"] == "degraded" else "silence", None, *tracker.answer(s), None, s["health"], self.boot)])


class Incidents(_Clocked):
    """The state machine of ``incidents.step`` with its own clock: no ``tick`` or ``restart`` commands are needed.

    A pending incident is dispatched by its timer once it has lasted ``persistence`` seconds, a retry at the next timer.
    A dispatch that has no answer after ``watch`` seconds, or that another run began, is failed with unknown delivery and never sent again.
    """

    schema = f"{incidents.STATE}, boot string"

    def __init__(self, boot: str, persistence: float = incidents.PERSISTENCE, watch: float = WATCH):
        self.boot, self.persistence, self.watch, self.keep = boot, persistence, watch, None

    def _load(self) -> dict:
        return dict(zip(_columns(self.schema), self.state.get() if self.state.exists() else (*incidents.START, self.boot), strict=True))

    def _lost(self, s: dict, now: float, late: bool = False):
        """What a restart under another run, or a missing answer, means for a dispatch that was under way."""
        other = s["boot"] != self.boot
        if s["status"] == "dispatching" and (other or late):
            yield from incidents.step(s, now, "restart", None, RESTARTED if other else UNANSWERED)
        s["boot"] = self.boot

    def _told(self, key, s: dict, events) -> list[tuple]:
        return [(key[0], s["incident"], at, event, "resolved" if event == "resolved" else s["status"], s["delivery"], s["attempts"], detail) for at, event, detail in events]

    def _due(self, s: dict, now: float) -> float | None:
        """When the state that begins now wants its timer, in milliseconds."""
        wait = {"pending": self.persistence, "dispatching": self.watch}.get(s["status"])
        return 1000 * now + 1 if s["retrying"] else None if wait is None else 1000 * (now + wait)

    def _done(self, s: dict, out: list[tuple], at: float | None) -> pd.DataFrame:
        self.state.update(tuple(s[f] for f in _columns(self.schema)))
        self._set(at)
        return pd.DataFrame(out, columns=_columns(incidents.EVENTS))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, now = self._load(), timerValues.getCurrentProcessingTimeInMs() / 1000
        stage = lambda: (s["incident"], s["status"], s["retrying"])
        due, was = next(iter(self.handle.listTimers()), None), stage()
        out = self._told(key, s, self._lost(s, now))
        for c in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples():
            if c.kind in ("start", "resolve", "delivered", "retry"):
                out += self._told(key, s, incidents.step(s, c.at, c.kind, None if pd.isna(c.ok) else bool(c.ok), c.detail))
        yield self._done(s, out, due if stage() == was else self._due(s, now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, now = self._load(), timerValues.getCurrentProcessingTimeInMs() / 1000
        out = self._told(key, s, self._lost(s, now, late=True))
        if s["status"] in ("pending", "failed"):
            at = now if s["started"] is None else max(now, s["started"] + self.persistence)
            out += self._told(key, s, incidents.step(s, at, "tick", persistence=self.persistence))
        yield self._done(s, out, self._due(s, now))


def session_stream(rows: DataFrame, boot: str, stale_after: float = STALE_AFTER, keep: float | None = FORGET) -> DataFrame:
    """Outcomes and health of a stream of ``tracker.ROWS``; ``boot`` names this run of the query."""
    return rows.groupBy("session").transformWithStateInPandas(Sessions(boot, stale_after, keep), SESSIONS, "Append", "ProcessingTime")


def incident_stream(commands: DataFrame, boot: str, persistence: float = incidents.PERSISTENCE, watch: float = WATCH) -> DataFrame:
    """Events of a stream of ``incidents.COMMANDS`` by the cluster's clock; ``boot`` names this run of the query."""
    return commands.groupBy("source").transformWithStateInPandas(Incidents(boot, persistence, watch), incidents.EVENTS, "Append", "ProcessingTime")
