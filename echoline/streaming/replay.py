"""Replay of scenarios with faults into a consumer that holds one window and waits with at most one more."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.sources.manifests import SAMPLE_RATE, WINDOW_SAMPLES

LOG = "session string, at double, step long, event string, seq long, reason string"


def arrivals(scenarios: DataFrame) -> DataFrame:
    """(session, arrival, seq, copy, fault): when each entry of a scenario reaches the consumer.

    A window is due at its end; a delay adds its seconds, a duplicate comes twice, a dropped one is marked.
    """
    entries = scenarios.select("session", F.posexplode("entries").alias("seq", "entry"), "incidents")
    entries = entries.select("session", F.col("seq").cast("long").alias("seq"), ((F.col("entry.source_offset_samples") + WINDOW_SAMPLES) / SAMPLE_RATE).alias("due"))
    faults = scenarios.select("session", F.explode("incidents").alias("i")).select("session", "i.*").withColumnRenamed("sequence", "seq")
    rows = entries.join(faults, ["session", "seq"], "left")
    late = F.when(F.col("kind") == "delay", F.col("seconds")).otherwise(0.0)
    copies = F.when(F.col("kind") == "duplicate", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("session", (F.col("due") + late).alias("arrival"), "seq", F.explode(copies).alias("copy"), F.col("kind").alias("fault"))


ARRIVALS = "session string, arrival double, seq long, copy int, fault string, busy double"
STATE = "active long, waiting long, free double, step long"
#: The ``fault`` of a row that ends its session: what is worked on and waits is finished.
END_OF_SESSION = "end"


class Slot:
    """What a consumer holds: the window it works on, the one that waits, and when it is free again.

    The newest window waits; what it replaces, and what is older than it, is lost. A window that is worked on or waits
    already is a duplicate.
    """

    def __init__(self, active: int | None = None, waiting: int | None = None, free: float = 0.0, step: int = 0):
        self.active, self.waiting, self.free, self.step = active, waiting, free, step

    def state(self) -> tuple:
        return self.active, self.waiting, self.free, self.step

    def until(self, time: float, busy: float) -> Iterator[tuple[float, str, int, str | None]]:
        """What is done before ``time``, and at it but for taking up the next window."""
        while self.active is not None and self.free <= time:
            yield self.free, "received", self.active, None
            self.active = None
            # What arrives at this very moment may still replace the waiting window.
            if self.waiting is not None and self.free < time:
                yield from self._take_up(self.free, busy)

    def _take_up(self, time: float, busy: float) -> Iterator[tuple[float, str, int, str | None]]:
        self.active, self.waiting, self.free = self.waiting, None, time + busy
        yield time, "processing", self.active, None

    def offer(self, time: float, at_once, busy: float) -> Iterator[tuple[float, str, int, str | None]]:
        """The rows (seq, fault) that arrive at one moment."""
        yield from self.until(time, busy)
        for seq, fault in at_once:
            if fault == "drop":
                yield time, "lost", seq, "transport_cut"
                continue
            yield time, "emitted", seq, None
            if seq in (self.active, self.waiting):
                yield time, "duplicate", seq, "ignored"
            elif self.waiting is not None and seq < self.waiting:
                yield time, "lost", seq, "older_than_pending"
            else:
                if self.waiting is not None:
                    yield time, "lost", self.waiting, "replaced_pending"
                self.waiting = seq
        if self.active is None and self.waiting is not None:
            yield from self._take_up(time, busy)


def deliver(events, busy_for: float) -> Iterator[tuple[float, str, int, str | None]]:
    """(time, event, seq, reason) of one session's arrivals, moments (time, [(seq, fault), ...]) in order, up to its end."""
    slot = Slot()
    for time, at_once in events:
        yield from slot.offer(time, at_once, busy_for)
    yield from slot.until(float("inf"), busy_for)


def _moments(pdf: pd.DataFrame) -> list[tuple[float, list]]:
    pdf = pdf.sort_values(["arrival", "seq", "copy"])
    return [(t, list(zip(g["seq"], g["fault"], strict=True))) for t, g in pdf.groupby("arrival", sort=True)]


def _session(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """State function: the slot of a session goes on from batch to batch; no more than a batch of it is held."""
    slot = Slot(*state.get) if state.exists else Slot()
    pdf, out = pd.concat(list(batches)), []
    ends = pdf["fault"] == END_OF_SESSION
    busy = float(pdf["busy"].iloc[0])
    for time, at_once in _moments(pdf[~ends]):
        out += slot.offer(time, at_once, busy)
    if ends.any():
        out += slot.until(float("inf"), busy)
    rows = [(key[0], t, slot.step + i, event, seq, reason) for i, (t, event, seq, reason) in enumerate(out)]
    slot.step += len(rows)
    state.update(slot.state())
    yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in LOG.split(", ")]).astype({"seq": "Int64"})


def replay_stream(rows: DataFrame) -> DataFrame:
    """The log of a stream of ``ARRIVALS``: one slot per session as keyed state in the query's checkpoint.

    Rows of a session come in the order of their arrival, those of one moment in one batch; a row of ``END_OF_SESSION`` finishes what is held.
    """
    return rows.groupBy("session").applyInPandasWithState(_session, LOG, STATE, "append", "NoTimeout")


def replay(scenarios: DataFrame) -> DataFrame:
    """The log of every scenario (session, entries, incidents, consumer_seconds), session by session.

    A session is one device's finite scenario, so its entries fit a task.
    """
    rows = arrivals(scenarios).join(scenarios.select("session", F.coalesce("consumer_seconds", F.lit(0.0)).alias("busy")), "session")

    def run(key, pdf):
        log = list(deliver(_moments(pdf), float(pdf["busy"].iloc[0])))
        return pd.DataFrame([(key[0], t, i, event, seq, reason) for i, (t, event, seq, reason) in enumerate(log)], columns=[x.split(" ")[0] for x in LOG.split(", ")])

    return rows.groupBy("session").applyInPandas(run, LOG)
