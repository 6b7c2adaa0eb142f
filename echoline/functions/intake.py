"""Expressions at the gate: which rows, signals, incidents and answers are taken, and what is told about them."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: The topologies of training and confirmation and the conditions kept for validation.
TRAIN_TOPOLOGY, CONFIRMATION_TOPOLOGY = "BR", "LO"
VALIDATION_CONDITIONS = ("0.47 LPS_N", "Transient_N")
#: Last second of the calendar, clock limits of a window in seconds, measures of a window.
LAST_SECOND, AHEAD, MAX_GAP, CADENCE, MEASURES = 253402300799, 0.25, 2.0, 0.01, 9
#: Factor over the baseline, sample of full scale, bytes of a raw recording.
RMS_FACTOR, FULL_SCALE, RAW_SAMPLES, MOST_RAW_BYTES = 1.6, 32767 / 32768, 240000, 2_000_000
#: Prefix and names of the amplitude text.
AMPLITUDE_PREFIX = "\nMeasured normalized-amplitude statistics (C1; six significant digits): "
AMPLITUDE_NAMES = ("facteur_crete", "kurtosis", "skewness", "abs_p50", "abs_p75", "abs_p90", "abs_p99", "ratio_p99_p50", "ecart_type_enveloppe")


def finite(v: Column) -> Column:
    """Whether a number is there, no NaN and not infinite; never null."""
    return F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))


def probability(v: Column) -> Column:
    """Whether a number is a probability; never null."""
    return F.coalesce(finite(v) & v.between(0, 1), F.lit(False))


def partition(topology: Column, condition: Column) -> Column:
    """``confirmation``, ``validation`` or ``train``; null for a topology that is not known."""
    of_training = F.when(condition.isin(*VALIDATION_CONDITIONS), "validation").otherwise("train")
    return F.when(topology == CONFIRMATION_TOPOLOGY, "confirmation").when(topology == TRAIN_TOPOLOGY, of_training)


def malformed(seq: Column, end: Column, received: Column, digest: Column, p: Column, problem: Column, measures: Column | None = None) -> Column:
    """Why a window can't be looked at at all, whatever came before it, or null."""
    clock = lambda t: finite(t) & t.between(0, LAST_SECOND)
    found = (
        F.when(seq.isNull() | (seq < 0), "sequence").when(~(clock(end) & clock(received)), "clock")
        .when(~F.coalesce(digest.rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest").when(p.isNotNull() & ~probability(p), "score")
        .when(p.isNull() & (F.coalesce(problem, F.lit("")) == ""), "abstention without a reason")
    )
    if measures is not None:
        found = F.coalesce(found, F.when(measures.isNotNull() & ((F.size(measures) != MEASURES) | F.exists(measures, lambda v: ~finite(v))), "measures"))
    return found


def untimely(end: Column, received: Column) -> Column:
    """``future`` or ``stale`` for a window that ends after it came or came long after its end, else null."""
    return F.when(end > received + AHEAD, "future").when(received - end > MAX_GAP, "stale")


def off_cadence(end: Column, last_end: Column, seq: Column, last_seq: Column) -> Column:
    """Whether the clock and the sequence moved apart since the window before; false for a first window."""
    return F.coalesce(F.abs((end - last_end) - (seq - last_seq)) > CADENCE, F.lit(False))


def public_health(ended: Column, health: Column, last_received: Column, created: Column, now: Column, same_boot: Column) -> Column:
    """What a session shows: ended, degraded once it is stale or its process has changed, else its own health."""
    stale = now - F.coalesce(last_received, created) > MAX_GAP
    return F.when(ended, "ended").when(stale | ~same_boot, "degraded").otherwise(health)


def anomalous(rms: Column, baseline: Column) -> Column:
    return rms > RMS_FACTOR * baseline


def full_scale(samples: Column) -> Column:
    """Number of samples at the limits of the converter."""
    return F.size(F.filter(samples, lambda v: (v <= -1) | (v >= FULL_SCALE)))


def incident_valid(x: Column, y: Column, started: Column, *times: Column) -> Column:
    """Whether a stored incident has a finite position, a start and no broken time."""
    sound = finite(x) & finite(y) & finite(started)
    for t in times:
        sound = sound & (t.isNull() | finite(t))
    return sound


def delivery_text(status: Column, delivery: Column, sent_at: Column, persistence: int = 30) -> Column:
    """What a panel says about the message of an incident; ``sent_at`` is a clock text."""
    return (
        F.when(status == "ANOMALY_PENDING", f"Armed · waiting {persistence} s").when(delivery == "dispatching", "Dispatching")
        .when((delivery == "sent") & sent_at.isNotNull(), F.concat(F.lit("Sent · "), sent_at))
        .when(delivery == "failed", "Notification failed · Telegram delivery unavailable")
        .when(delivery == "unknown", "Delivery unconfirmed · check Telegram before any new alert").otherwise("Not dispatched")
    )


def alert_text(seconds: Column, sensor: Column, zone: Column, detected: Column, source: Column, verification: Column, title: str = "🚨 Alert") -> Column:
    """The message of an alert, line by line, under its title; a null ``verification`` has no line."""
    named = F.when(source == "injected_test", "injected test incident").otherwise(source)
    body = F.concat(F.lit("Persistent abnormal signal detected for "), seconds.cast("string"), F.lit(" seconds."))
    return F.concat_ws(
        "\n", F.lit(title), F.lit(""), body, F.concat(F.lit("Strongest response: Sensor "), sensor.cast("string")), F.concat(F.lit("Zone: "), zone),
        F.lit("Action: inspection recommended."), F.concat(F.lit("Detected: "), detected), F.lit(""), F.concat(F.lit("Source: "), named), F.concat(F.lit("Verification: "), verification),
    )


def outcome(verdicts: Column) -> Column:
    """One word for an array of verdicts: a single degradation decides, an improvement must be in all."""
    bad, good = "compatible with degradation", "compatible with improvement"
    return F.when(F.array_contains(verdicts, bad), "degradation").when((F.size(verdicts) > 0) & F.forall(verdicts, lambda v: v == good), "improvement").otherwise("inconclusive")


def six_decimals(v: Column) -> Column:
    """Half-even rounding to six decimals, as reports have it."""
    return F.bround(v, 6)


@F.pandas_udf(StringType())
def amplitude_text(values: pd.Series) -> pd.Series:
    """Nine measures with six significant digits each, or null if they are not nine finite numbers."""

    def text(v) -> str | None:
        v = np.asarray(v if v is not None else [], float)
        return AMPLITUDE_PREFIX + "; ".join(f"{n}={x:.6g}" for n, x in zip(AMPLITUDE_NAMES, v, strict=True)) if v.shape == (len(AMPLITUDE_NAMES),) and np.isfinite(v).all() else None

    return values.map(text)


@F.pandas_udf(ArrayType(DoubleType()))
def raw_pcm32(content: pd.Series) -> pd.Series:
    """The first 240000 samples of raw little-endian 32-bit sound, divided exactly by 2^31; null for other lengths."""
    sound = lambda c: c is not None and len(c) % 4 == 0 and RAW_SAMPLES * 4 <= len(c) <= MOST_RAW_BYTES
    return content.map(lambda c: np.frombuffer(c, "<i4", RAW_SAMPLES) / 2.0**31 if sound(c) else None)


def waveform_identity(format_name: str):
    """A pandas UDF (samples, rate) -> SHA-256 of a signal's numbers as 64-bit floats after a header that names format, rate and length.

    ``format_name`` is part of the identity, so a study must name its own. Null for null or non-finite signals.
    """
    import hashlib

    if not format_name:
        raise ValueError("a format name is needed")

    def identity(x, r) -> str | None:
        x = np.asarray(x if x is not None else [np.nan], "<f8")
        if not np.isfinite(x).all():
            return None
        header = json.dumps({"format": format_name, "sample_rate": int(r), "shape": [len(x)]}, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(header.encode() + b"\x00" + x.tobytes()).hexdigest()

    @F.pandas_udf(StringType())
    def run(samples: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([identity(x, r) for x, r in zip(samples, rate, strict=True)])

    return run
