"""Feature vectors of signals as Arrow-batched functions: a batch of equal-length signals is one matrix.

Families: ``level`` (raw), ``amplitude`` (shape of the amplitudes), ``spectral`` (energy over frequency), ``dynamics``
(order in time, from the envelope) and ``mixed``. All but ``level`` remove the mean and the gain first.
A null, empty, ragged-length or non-finite signal has null features.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from echoline.functions.config import SAMPLE_RATE

#: Band edges in Hz, lags of the envelope's correlation, modulation bands in Hz, frames of the flux.
BANDS = ((0, 250), (250, 500), (500, 1000), (1000, 2000), (2000, 4000))
LAGS = (32, 2000)
MODULATION = ((1, 4), (4, 16), (16, 64))
FRAME, HOP = 256, 128
TINY = 1e-12

_BAND_NAMES = [f"band_{lo}_{hi}" for lo, hi in BANDS]
NAMES = {
    "level": ["rms_dbfs"],
    "amplitude": ["crest", "kurtosis", "skewness", "abs_p50", "abs_p75", "abs_p90", "abs_p99", "p99_over_p50", "envelope_std"],
    "spectral": ["centroid_hz", "spread_hz", "flatness", *_BAND_NAMES],
    "dynamics": ["envelope_peak", "modulation_peak_log_hz", *[f"modulation_{lo}_{hi}" for lo, hi in MODULATION], "flux"],
    "mixed": ["centroid_hz", "spread_hz", "rolloff85_hz", "flatness", *_BAND_NAMES, "zero_crossings", "crest"],
}


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows with mean 0 and RMS 1; constant rows stay 0."""
    m = m - m.mean(axis=1, keepdims=True)
    rms = np.sqrt((m * m).mean(axis=1, keepdims=True))
    return np.divide(m, rms, out=m, where=rms > 0)


def _power(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spectrum = np.abs(np.fft.rfft(m * np.hanning(m.shape[1]), axis=1)) ** 2
    return spectrum, np.fft.rfftfreq(m.shape[1], 1 / SAMPLE_RATE)


def _banded(spectrum: np.ndarray, freqs: np.ndarray, bands) -> np.ndarray:
    """Sums over frequency bands as one product with their indicator matrix."""
    return spectrum @ np.stack([(freqs >= lo) & (freqs < hi) for lo, hi in bands], axis=1).astype(float)


def level(m: np.ndarray) -> np.ndarray:
    return 20 * np.log10(m.std(axis=1, keepdims=True) / 32768 + TINY)


def amplitude(m: np.ndarray) -> np.ndarray:
    m = _unit(m)
    size = np.abs(m)
    second = (m * m).mean(axis=1)
    p50, p75, p90, p99 = np.percentile(size, (50, 75, 90, 99), axis=1)
    whole = m.shape[1] // 20 * 20
    blocks = np.sqrt((m[:, :whole].reshape(len(m), 20, -1) ** 2).mean(axis=2)) if whole else np.zeros((len(m), 1))
    power = lambda k: (m**k).mean(axis=1) / (second + TINY) ** (k / 2)
    return np.stack([size.max(axis=1) / (np.sqrt(second) + TINY), power(4), power(3), p50, p75, p90, p99, p99 / (p50 + TINY), blocks.std(axis=1)], axis=1)


def _shape(m: np.ndarray) -> dict[str, np.ndarray]:
    spectrum, freqs = _power(m)
    share = spectrum / (spectrum.sum(axis=1, keepdims=True) + TINY)
    centroid = share @ freqs
    return {
        "centroid": centroid, "spread": np.sqrt((share * (freqs - centroid[:, None]) ** 2).sum(axis=1)),
        "rolloff": freqs[np.minimum((np.cumsum(share, axis=1) < 0.85).sum(axis=1), len(freqs) - 1)],
        "flatness": np.exp(np.log(spectrum + TINY).mean(axis=1)) / (spectrum.mean(axis=1) + TINY), "bands": _banded(share, freqs, BANDS),
    }


def spectral(m: np.ndarray) -> np.ndarray:
    s = _shape(_unit(m))
    return np.column_stack([s["centroid"], s["spread"], s["flatness"], s["bands"]])


def mixed(m: np.ndarray) -> np.ndarray:
    m = _unit(m)
    s = _shape(m)
    turns = (np.diff(np.sign(m), axis=1) != 0).mean(axis=1)
    crest = np.abs(m).max(axis=1) / (np.sqrt((m * m).mean(axis=1)) + TINY)
    return np.column_stack([s["centroid"], s["spread"], s["rolloff"], s["flatness"], s["bands"], turns, crest])


def dynamics(m: np.ndarray) -> np.ndarray:
    m = _unit(m)
    n = m.shape[1]
    envelope = np.abs(m)
    envelope -= envelope.mean(axis=1, keepdims=True)
    # Correlation of the envelope with itself by the transform of its padded spectrum, per number of terms.
    padded = np.abs(np.fft.rfft(envelope, 2 * n, axis=1)) ** 2
    lagged = np.fft.irfft(padded, axis=1)[:, :n] / np.arange(n, 0, -1)
    part = lagged[:, LAGS[0] : LAGS[1]]
    peak = part.max(axis=1) / (lagged[:, 0] + TINY) if part.shape[1] else np.full(len(m), np.nan)
    spectrum, freqs = _power(envelope)
    searched = (freqs >= SAMPLE_RATE / LAGS[1]) & (freqs <= SAMPLE_RATE / LAGS[0])
    if searched.any():
        top = np.log10(freqs[searched][spectrum[:, searched].argmax(axis=1)])
        bands = _banded(spectrum, freqs, MODULATION) / (spectrum[:, searched].sum(axis=1, keepdims=True) + TINY)
    else:
        top, bands = np.full(len(m), np.nan), np.full((len(m), len(MODULATION)), np.nan)
    flux = np.zeros(len(m))
    if n >= FRAME + HOP:
        frames = np.lib.stride_tricks.sliding_window_view(m, FRAME, axis=1)[:, ::HOP]
        energy = _banded(np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=2)) ** 2, np.fft.rfftfreq(FRAME, 1 / SAMPLE_RATE), BANDS)
        energy /= energy.sum(axis=2, keepdims=True) + TINY
        flux = np.abs(np.diff(energy, axis=1)).sum(axis=2).mean(axis=1)
    return np.column_stack([peak, top, bands, flux])


FAMILIES: dict[str, Callable[[np.ndarray], np.ndarray]] = {"level": level, "amplitude": amplitude, "spectral": spectral, "dynamics": dynamics, "mixed": mixed}


def features(family: str, single: bool = False):
    """A pandas UDF from array<double> to a struct of the family's features.

    ``single`` normalises the signal and passes it through single precision first, as stored signals have been.
    """
    compute, names = FAMILIES[family], NAMES[family]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def run(signals: pd.Series) -> pd.DataFrame:
        out = np.full((len(signals), len(names)), np.nan)
        arrays = [None if x is None else np.asarray(x, float) for x in signals]
        good = [i for i, x in enumerate(arrays) if x is not None and len(x) and np.isfinite(x).all()]
        by_length: dict[int, list[int]] = {}
        for i in good:
            by_length.setdefault(len(arrays[i]), []).append(i)
        for rows in by_length.values():
            m = np.stack([arrays[i] for i in rows])
            out[rows] = compute(_unit(m).astype(np.float32).astype(float) if single else m)
        return pd.DataFrame(out, columns=names).astype(object).where(~np.isnan(out), None)

    return run
