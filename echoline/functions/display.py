"""Expressions for displays: scales, clocks, ring geometry, readings of a synthetic sensor, distances to segments."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Floor in dB, most columns shown, attenuation length, healthy (rms, crest) per sensor, RMS factor, sample period.
FLOOR_DB, MOST_COLUMNS, ATTENUATION = 120.0, 72, 260.0
BASELINES = ((12.1, 5.1), (13.0, 4.9), (11.4, 5.3))
RMS_FACTOR, SAMPLE_MS, CONFIRM, LONGEST_RUN = 1.6, 500, 2, 481
#: Fixed values of a ring: least top frequency, bands, dB below which there is no centroid, inner radius and depth.
LEAST_TOP, BANDS, SILENT_DB, INNER, DEPTH = 1.0, 3, -119.99, 0.18, 0.95
#: Fixed values of a synthetic reading: noise of rms and crest, drift and its samples, spikes, the ramp and rise of an incident, the least crest.
NOISE, DRIFT, DRIFT_SAMPLES = (0.35, 0.22), 0.25, 9
SPIKE_OVER, SPIKE, SPIKE_CREST = 0.985, (3, 5), 0.18
RAMP_SAMPLES, INCIDENT, INCIDENT_NOISE, LEAST_CREST = 6, (22, -1.8), 0.12, 1.2


def unit(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def loop_time(clock: Column, duration: Column) -> Column:
    return F.pmod(clock, duration)


def clock_text(seconds: Column) -> Column:
    """mm:ss.s of a non-negative time."""
    s = F.greatest(F.lit(0.0), seconds)
    minutes = F.floor(s / 60)
    return F.format_string("%02d:%04.1f", minutes, s - minutes * 60)


def sample_at(epoch_ms: Column) -> Column:
    return F.floor(epoch_ms / SAMPLE_MS)


def _power_db(power: Column) -> Column:
    return 10 * F.log10(F.greatest(power, F.lit(1e-12)))


def sound_spectrogram(frequencies: Column, matrix: Column, times: Column) -> Column:
    """Whether a spectrogram in dB (frequencies x times) is whole: not empty, every row as long as the times, all numbers finite."""
    number = lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))
    axis = lambda a: (F.size(a) > 0) & F.forall(a, lambda v: number(v) & (v >= 0))
    rows = F.forall(matrix, lambda row: (F.size(row) == F.size(times)) & F.forall(row, number))
    return F.coalesce(axis(times) & axis(frequencies) & (F.size(matrix) == F.size(frequencies)) & rows, F.lit(False))


def rings(spectrograms: DataFrame, key: str) -> DataFrame:
    """One row for each shown column of spectrograms (key, frequencies, matrix, times): (key, time, energy_db, centroid_hz, bands_db, radius, angle).

    The matrix is exploded to cells, and each ring is one aggregate of its cells. At most ``MOST_COLUMNS`` of the measured columns are
    shown, at an even stride, none is interpolated; spectrograms that aren't whole have no rows.
    """
    whole = spectrograms.filter(sound_spectrogram(F.col("frequencies"), F.col("matrix"), F.col("times")))
    bins = whole.select(
        key, "times", F.greatest(F.lit(LEAST_TOP), F.array_max("frequencies")).alias("top"), F.ceil(F.size("times") / MOST_COLUMNS).cast("int").alias("stride"),
        F.explode(F.arrays_zip("frequencies", "matrix")).alias("bin"),
    )
    cells = bins.select(key, "top", "stride", F.col("bin.frequencies").alias("f"), F.posexplode(F.arrays_zip("times", F.col("bin.matrix").alias("db"))).alias("t", "cell"))
    cells = cells.filter(F.col("t") % F.col("stride") == 0).withColumns({"power": F.pow(F.lit(10.0), F.col("cell.db") / 10), "band": F.least(F.lit(BANDS - 1), F.floor(F.col("f") / F.col("top") * BANDS))})
    band = lambda b: _power_db(F.coalesce(F.avg(F.when(F.col("band") == b, F.col("power"))), F.lit(0.0)))
    made = cells.groupBy(key, "t").agg(
        F.first("cell.times").alias("time"), F.first("top").alias("top"), _power_db(F.avg("power")).alias("energy_db"), F.try_divide(F.sum(F.col("power") * F.col("f")), F.sum("power")).alias("mean_hz"),
        F.array(*map(band, range(BANDS))).alias("bands_db"),
    )
    made = made.withColumn("centroid_hz", F.when(F.col("energy_db") > SILENT_DB, F.col("mean_hz")).otherwise(0.0))
    return made.select(key, "time", "energy_db", "centroid_hz", "bands_db", (INNER + DEPTH * unit(F.col("energy_db"), -FLOOR_DB, 0.0)).alias("radius"), (F.col("centroid_hz") / F.col("top") * math.pi).alias("angle"))


def shown(rows: DataFrame, key: str, order: str, most: int = MOST_COLUMNS) -> DataFrame:
    """At most ``most`` rows of each key, at an even stride from its first in the order of ``order``; none is interpolated."""
    w = Window.partitionBy(key)
    placed = rows.withColumns({"__k": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    return placed.filter(F.col("__k") % F.greatest(F.lit(1), F.ceil(F.col("__n") / most)) == 0).drop("__k", "__n")


def noise(sensor: Column, k: Column, salt: int) -> Column:
    """Deterministic pseudo-noise in [-1, 1]: the fraction of a steep sine."""
    x = F.sin((k + 1) * 12.9898 + sensor * 78.233 + salt * 37.719) * 43758.5453
    return (x - F.floor(x)) * 2 - 1


def _contributions(sensor: Column, k: Column, start: Column | None, level: Column | None) -> list[tuple[Column, Column]]:
    """What adds up to a reading, as (to the rms, to the crest): level, noise, drift, rare spikes and an incident."""
    zero = F.lit(0.0)
    healthy = lambda i: F.element_at(F.array(*[F.lit(b[i]) for b in BASELINES]), (sensor + 1).cast("int"))
    spike = F.when(noise(sensor, k, 3) > SPIKE_OVER, SPIKE[0] + SPIKE[1] * F.abs(noise(sensor, k, 4))).otherwise(zero)
    parts = [(healthy(0), healthy(1)), (NOISE[0] * noise(sensor, k, 1), NOISE[1] * noise(sensor, k, 2)), (DRIFT * F.sin(k / DRIFT_SAMPLES + sensor), zero), (spike, SPIKE_CREST * spike)]
    if start is not None:
        grown = F.least((k - start) / RAMP_SAMPLES, F.lit(1.0))
        strength = F.coalesce(F.when(k >= start, grown * level), zero)
        parts.append((INCIDENT[0] * strength * (1 + INCIDENT_NOISE * noise(sensor, k, 5)), INCIDENT[1] * strength))
    return parts


def reading(sensor: Column, k: Column, start: Column | None = None, level: Column | None = None) -> Column:
    """Struct (rms, crest) of a synthetic sensor: the sum of its contributions; from sample ``start`` an incident ramps up to its ``level``."""
    rms, crest = (reduce(lambda a, b: a + b, column) for column in zip(*_contributions(sensor, k, start, level), strict=True))
    return F.struct(rms.alias("rms"), F.greatest(F.lit(LEAST_CREST), crest).alias("crest"))


def status(run: Column, confirmed: Column) -> Column:
    return F.when(run < CONFIRM, "healthy").when(confirmed, "confirmed").otherwise("under observation")


def polyline(path: Column) -> Column:
    """Points (x, y) of an axis-aligned path of M, H and V commands."""
    steps = F.regexp_extract_all(path, F.lit(r"([MHV]\s*[-\d.,\s]+)"), F.lit(1))
    start = F.array().cast("array<struct<x:double,y:double>>")

    def step(points: Column, text: Column) -> Column:
        numbers = F.transform(F.split(F.trim(F.substring(text, 2, 1 << 20)), r"[\s,]+"), lambda n: n.cast("double"))
        last, kind = F.element_at(points, -1), F.substring(text, 1, 1)
        x = F.when(kind == "V", last["x"]).otherwise(F.get(numbers, F.lit(0)))
        y = F.when(kind == "M", F.get(numbers, F.lit(1))).when(kind == "V", F.get(numbers, F.lit(0))).otherwise(last["y"])
        return F.concat(points, F.array(F.struct(x.alias("x"), y.alias("y"))))

    return F.aggregate(steps, start, step)


def nearest_on_segment(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Struct (distance, x, y) of the point of a segment that is nearest to (px, py)."""
    dx, dy = x1 - x0, y1 - y0
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - x0) * dx + (py - y0) * dy, dx * dx + dy * dy))), F.lit(0.0))
    x, y = x0 + t * dx, y0 + t * dy
    return F.struct(F.hypot(px - x, py - y).alias("distance"), x.alias("x"), y.alias("y"))


def nearest_segments(points: DataFrame, px: str, py: str, net: DataFrame, key: str) -> DataFrame:
    """``points`` with the ``key`` and ``distance`` of their nearest segment of a drawing (key, x0, y0, x1, y1); the least key on a tie.

    The drawing is small and goes to the tasks; points without a coordinate have null, and without any segment there are no rows.
    """
    drawn = net.filter("x0 is not null and y0 is not null and x1 is not null and y1 is not null").orderBy(key).collect()
    kind = net.schema[key].dataType
    if not drawn:
        return points.filter(F.lit(False)).select("*", F.lit(None).cast(kind).alias(key), F.lit(None).cast("double").alias("distance"))
    names, ends = [r[key] for r in drawn], np.array([[r["x0"], r["y0"], r["x1"], r["y1"]] for r in drawn], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x0, y0, x1, y1 = ends.T
        dx, dy = x1 - x0, y1 - y0
        square = dx * dx + dy * dy
        for b in batches:
            x, y = (b.column(c).to_numpy(zero_copy_only=False).astype(float)[:, None] for c in (px, py))
            t = np.divide((x - x0) * dx + (y - y0) * dy, square, out=np.zeros((len(x), len(x0))), where=square > 0)
            t = np.clip(t, 0.0, 1.0)
            far = np.hypot(x - (x0 + t * dx), y - (y0 + t * dy))
            unknown = np.isnan(far).any(axis=1)
            best = np.where(np.isnan(far), np.inf, far).argmin(axis=1)
            least = far[np.arange(len(best)), best]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.int32(), mask=unknown), pa.array(least, mask=unknown)], [*b.schema.names, "__k", "distance"])

    told = points.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("__k", T.IntegerType()), T.StructField("distance", T.DoubleType())]))
    return told.select(*points.columns, F.get(F.array(*map(F.lit, names)), F.col("__k")).cast(kind).alias(key), "distance")


def response(distance: Column) -> Column:
    return F.exp(-distance / ATTENUATION)
