"""Energy over time of a window: band series, the dominant band, and pooled views for display."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoline.functions.config import SAMPLE_RATE

#: The four bands in Hz, transform length and hop, frames without padding and steps with it.
BANDS = ((0, 1000), (1000, 2000), (2000, 3000), (3000, 4000))
FFT, HOP = 256, 128
FRAMES, STEPS = 61, 64
BAND_NAMES = tuple(f"{lo}-{hi}" for lo, hi in BANDS)


def _frames(x: np.ndarray, width: int, hop: int) -> np.ndarray:
    """One-sided power of Hann-weighted whole frames: frames x frequencies."""
    window = np.hanning(width)
    cut = np.lib.stride_tricks.sliding_window_view(x, width)[::hop]
    power = np.abs(np.fft.rfft(cut * window)) ** 2 / (width * (window @ window))
    power[:, 1 : (width + 1) // 2] *= 2
    return power


def band_energies(x: np.ndarray) -> np.ndarray:
    """log1p of each band's energy per frame, in single precision, filled with zeros to a multiple of 4 steps."""
    freqs = np.fft.rfftfreq(FFT, 1 / SAMPLE_RATE)
    band = np.minimum(freqs // 1000, len(BANDS) - 1)
    energy = np.stack([_frames(x, FFT, HOP)[:, band == b].sum(axis=1) for b in range(len(BANDS))])
    out = np.zeros((len(BANDS), -(-energy.shape[1] // 4) * 4), np.float32)
    out[:, : energy.shape[1]] = np.log1p(energy)
    return out


def _series_of(single: bool):
    """A function from a finite signal to its band series; mean and gain are removed first."""

    def make(x: np.ndarray) -> list:
        x = x - x.mean()
        rms = np.sqrt((x * x).mean())
        x = x / rms if rms > 0 else x
        return band_energies(x.astype(np.float32).astype(float) if single else x).astype(float).tolist()

    return make


def band_series(single: bool = False):
    """A pandas UDF from a signal to its band series; mean and gain are removed first.

    ``single`` passes the normalised samples through single precision. Null, short or non-finite signals give null.
    """

    make = _series_of(single)

    @F.pandas_udf("array<array<double>>")
    def run(signals: pd.Series) -> pd.Series:
        arrays = [None if x is None else np.asarray(x, float) for x in signals]
        return pd.Series([None if x is None or len(x) < FFT or not np.isfinite(x).all() else make(x) for x in arrays])

    return run


def preprocessed(version: str, versions: dict[str, bool]):
    """A pandas UDF (signal, rate) -> struct (series, problem): the band series of one known version of the preprocessing.

    ``versions`` says of each version whether signals pass through single precision; any other version is refused at once, any
    other rate or length, and signals that aren't finite, by the problem.
    """
    if version not in versions:
        raise ValueError(f"preprocessing {version} is not one of {sorted(versions)}")
    make = _series_of(versions[version])

    @F.pandas_udf("series array<array<double>>, problem string")
    def run(signals: pd.Series, rates: pd.Series) -> pd.DataFrame:
        out = []
        for x, rate in zip(signals, rates, strict=True):
            x = None if x is None else np.asarray(x, float)
            problem = "missing" if x is None else "sample_rate" if rate != SAMPLE_RATE else "length" if len(x) != SAMPLE_RATE else None if np.isfinite(x).all() else "not_finite"
            out.append((None if problem else make(x), problem))
        return pd.DataFrame(out, columns=["series", "problem"])

    return run


def log_spectrum(samples: int = SAMPLE_RATE, width: int = FFT):
    """A pandas UDF from a signal to log1p of its short-time magnitudes, frequencies by frames in one array, for comparing signals.

    The signal is cut or filled to ``samples``, then set between half a frame of zeros on either side and filled to whole frames, which
    overlap by half. A null or non-finite signal gives null.
    """
    hop, window = width // 2, np.hanning(width + 1)[:-1]

    @F.pandas_udf("array<double>")
    def run(signals: pd.Series) -> pd.Series:
        out = []
        for x in signals:
            x = None if x is None else np.asarray(x, float)[:samples]
            if x is None or not np.isfinite(x).all():
                out.append(None)
                continue
            whole = np.zeros(hop + samples + hop + (-samples) % hop)
            whole[hop : hop + len(x)] = x
            cut = np.lib.stride_tricks.sliding_window_view(whole, width)[::hop]
            out.append(np.log1p(np.abs(np.fft.rfft(cut * window)) / window.sum()).T.ravel())
        return pd.Series(out)

    return run


def dominant_band(series: Column, frames: int = FRAMES) -> Column:
    """Name of the band of the largest mean energy; the lower one on a tie."""
    energy = F.transform(series, lambda band: F.aggregate(F.slice(band, 1, frames), F.lit(0.0), lambda acc, v: acc + F.expm1(v)))
    return F.element_at(F.array(*map(F.lit, BAND_NAMES)), F.array_position(energy, F.array_max(energy)).cast("int"))


def target_text(label: Column, series: Column) -> Column:
    return F.concat(label, F.lit("; Greatest mean spectral energy: "), dominant_band(series), F.lit(" Hz."))


def pooled(x: Column, most: int) -> Column:
    """(lo, hi) of at most ``most`` equal blocks of a signal, in order, for display."""
    step = F.ceil(F.size(x) / most).cast("int")
    return F.when(F.size(x) > 0, F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(x) / step).cast("int") - 1),
        lambda i: F.struct(F.array_min(F.slice(x, i * step + 1, step)).alias("lo"), F.array_max(F.slice(x, i * step + 1, step)).alias("hi")),
    ))


def rewindowed(x: Column, samples: int) -> Column:
    """Consecutive windows of a recording as structs (window, samples); a shorter rest is left out."""
    return F.when(F.size(x) >= samples, F.transform(
        F.sequence(F.lit(0), F.floor(F.size(x) / samples).cast("int") - 1), lambda i: F.struct(i.alias("window"), F.slice(x, i * samples + 1, samples).alias("samples"))
    ))


@F.pandas_udf(T.StringType())
def signal_digest(signals: pd.Series) -> pd.Series:
    """SHA-256 of the samples as little-endian doubles, with -0.0 as 0.0."""
    return pd.Series([None if x is None else hashlib.sha256((np.asarray(x, "<f8") + 0.0).tobytes()).hexdigest() for x in signals])
