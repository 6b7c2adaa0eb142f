"""What a display shows of a sound: least and greatest samples of blocks, and a spectrogram pooled before it becomes decibels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blocks of a waveform, cells of a spectrogram, its transform, and the floor of its power.
BLOCKS, FREQUENCIES, TIMES, TRANSFORM = 800, 256, 400, 1024
FLOOR = 1e-12
VIEW = "block_times array<double>, lo array<double>, hi array<double>, times array<double>, frequencies_hz array<double>, power_db array<array<double>>"
NAMES = [c.split(" ")[0] for c in VIEW.split(", ")]
#: Rows whose views a task holds at a time.
STEPS = 64


def cuts(n: int, most: int) -> np.ndarray:
    """Where ``n`` things are cut into at most ``most`` groups whose sizes differ by one, larger ones first."""
    groups = min(n, most)
    size, over = divmod(n, groups)
    return np.concatenate([[0], np.cumsum([size + (i < over) for i in range(groups)])]).astype(int)


def pooled(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Means of the groups of rows between the cuts ``at``."""
    return np.add.reduceat(x, at[:-1], axis=0) / np.diff(at).reshape(-1, *[1] * (x.ndim - 1))


def spectrogram(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times, frequencies, decibels by frequency and time): mean power of unequal groups on both axes, then logarithms."""
    width = min(TRANSFORM, len(x))
    hop = max(1, width // 4)
    window = np.hanning(width + 1)[:-1] if width > 1 else np.ones(1)
    frames = np.lib.stride_tricks.sliding_window_view(x, width)[::hop]
    power = np.abs(np.fft.rfft(frames * window) / window.sum()) ** 2
    times, freqs = (np.arange(len(frames)) * hop + width / 2) / rate, np.fft.rfftfreq(width, 1 / rate)
    by_time, by_freq = cuts(len(times), TIMES), cuts(len(freqs), FREQUENCIES)
    cells = pooled(pooled(power, by_time).T, by_freq)
    return pooled(times, by_time), pooled(freqs, by_freq), 10 * np.log10(np.maximum(cells, FLOOR))


def _seen(x, rate: float) -> list:
    """The fields of ``VIEW``; nulls for a null, empty or non-finite signal."""
    x = None if x is None else np.asarray(x, float)
    if x is None or not len(x) or not np.isfinite(x).all() or not rate > 0:
        return [None] * 6
    at = cuts(len(x), BLOCKS)
    # The blocks' times are cut evenly, as their display has them, also where blocks differ by a sample.
    starts = np.linspace(0, len(x), len(at), dtype=int)[:-1] / rate
    times, freqs, db = spectrogram(x, float(rate))
    return [starts, np.minimum.reduceat(x, at[:-1]), np.maximum.reduceat(x, at[:-1]), times, freqs, list(np.round(db, 2))]


def viewed(rows: DataFrame, samples: str, rate: float, steps: int = STEPS) -> DataFrame:
    """The columns of ``rows`` but ``samples``, and those of ``VIEW``; a task holds the views of ``steps`` rows at a time, whatever the batches' size."""
    kept = [f for f in rows.schema.fields if f.name != samples]
    kinds = [pa.list_(pa.float64())] * 5 + [pa.list_(pa.list_(pa.float64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, steps):
                b = batch.slice(at, steps)
                made = [_seen(x.values.to_numpy(zero_copy_only=False) if x.is_valid else None, rate) for x in b.column(samples)]
                yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], *[pa.array(list(c), k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]], [*[f.name for f in kept], *NAMES])

    return rows.mapInArrow(run, T.StructType([*kept, *T.StructType.fromDDL(VIEW).fields]))


def view():
    """A pandas UDF (mono signal, rate) -> struct of ``VIEW``; null for null, empty or non-finite signals."""

    @F.pandas_udf(VIEW)
    def run(signals: pd.Series, rates: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_seen(x, rate) for x, rate in zip(signals, rates, strict=True)], columns=NAMES)

    return run
