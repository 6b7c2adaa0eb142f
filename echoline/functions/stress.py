"""Changes of a signal that keep some of its statistics, as Arrow-batched functions seeded by (name, id)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Samples per permuted block and the base of all seeds.
BLOCK, BASE_SEED = 250, 20260912
UNIT = "\x1f"


def seed(name: str, key: Column, base: int = BASE_SEED) -> Column:
    """First 8 bytes, big-endian, of the SHA-256 of base, name and key; unsigned, so a decimal."""
    digest = F.sha2(F.concat_ws(UNIT, F.lit(str(base)), F.lit(name), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def permuted(x: np.ndarray, rng: np.random.Generator, block: int = BLOCK) -> np.ndarray | None:
    """Blocks in random order; None if the length is no multiple of the block, since a rest would stay in place."""
    return None if len(x) % block else rng.permutation(x.reshape(-1, block)).ravel()


def rephased(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Random phases under the same magnitudes; bins that must be real keep their sign."""
    spectrum = np.fft.rfft(x)
    turn = np.exp(1j * rng.uniform(-np.pi, np.pi, len(spectrum)))
    real = [0, -1] if len(x) % 2 == 0 else [0]
    changed = np.abs(spectrum) * turn
    changed[real] = spectrum[real].real
    return np.fft.irfft(changed, len(x))


def _seeded(change):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(signals: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or not len(x) else change(np.asarray(x, float), np.random.default_rng(int(s))) for x, s in zip(signals, seeds, strict=True)])

    return run


def original(x: Column, key: Column) -> Column:
    return x


def reversed_(x: Column, key: Column) -> Column:
    return F.reverse(x)


def block_permutation(x: Column, key: Column, block: int = BLOCK) -> Column:
    return _seeded(lambda v, rng: permuted(v, rng, block))(x, seed("T2", key))


def phase_randomisation(x: Column, key: Column) -> Column:
    return _seeded(rephased)(x, seed("T3", key))


CHANGES = {"T0": original, "T1": reversed_, "T2": block_permutation, "T3": phase_randomisation}

INVARIANTS = ("rms_change", "same_values", "magnitude_distance", "sample_distance")


@F.pandas_udf(T.StructType([T.StructField(n, T.BooleanType() if n == "same_values" else T.DoubleType()) for n in INVARIANTS]))
def invariants(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """What a change kept: relative change of RMS, equal sorted samples, relative distances of magnitudes and samples."""
    out = []
    for a, b in zip(before, after, strict=True):
        if a is None or b is None or len(a) != len(b):
            out.append((None, None, None, None))
            continue
        a, b = np.asarray(a, float), np.asarray(b, float)
        size = lambda v: np.linalg.norm(v) + 1e-12
        ma, mb = np.abs(np.fft.rfft(a)), np.abs(np.fft.rfft(b))
        out.append(((size(b) - size(a)) / size(a), bool((np.sort(a) == np.sort(b)).all()), np.linalg.norm(ma - mb) / size(ma), np.linalg.norm(a - b) / size(a)))
    return pd.DataFrame(out, columns=list(INVARIANTS))
