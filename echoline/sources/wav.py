"""WAV files as a table: ``binaryFile`` scan and a strict decoder that reports instead of raising."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.functions.config import SAMPLE_RATE, WINDOW_SAMPLES

_TYPES = {2: "<i2", 4: "<i4"}


#: Sample widths in bytes that a policy takes: ``strict`` is PCM16 alone.
POLICIES = {"strict": (2,), "wide": (2, 4)}


def decoded(data: bytes | None, samples: int, rate: int, policy: str = "wide") -> tuple[np.ndarray | None, str | None]:
    """(samples scaled to [-1, 1), None) or (None, reason); ``policy`` names the sample widths that are taken."""
    if data is None:
        return None, "missing"
    try:
        with wave.open(io.BytesIO(data)) as w:
            width, n = w.getsampwidth(), w.getnframes()
            for ok, reason in ((w.getnchannels() == 1, "channels"), (width in POLICIES[policy], "sample_width"), (w.getframerate() == rate, "sample_rate"), (n == samples, "length")):
                if not ok:
                    return None, reason
            raw = w.readframes(n)
    except (wave.Error, EOFError):
        return None, "not_wav"
    if len(raw) != n * width:
        return None, "length"
    return np.frombuffer(raw, _TYPES[width]) / float(1 << (8 * width - 1)), None


def decode(samples: int = WINDOW_SAMPLES, rate: int = SAMPLE_RATE, policy: str = "wide"):
    """A pandas UDF from WAV bytes to struct<samples, problem>: mono PCM of exactly so many samples, of the widths of the policy."""
    if policy not in POLICIES:
        raise ValueError(f"policy {policy} is not one of {sorted(POLICIES)}")

    @F.pandas_udf("samples array<double>, problem string")
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decoded(x, samples, rate, policy) for x in content], columns=["samples", "problem"])

    return run


def fitted(samples, size: int = WINDOW_SAMPLES):
    """Cut a signal to ``size``, or fill it with zeros at its end."""
    return F.slice(F.concat(samples, F.array_repeat(F.lit(0.0), size)), 1, size)


def read_wav(spark: SparkSession, path: str, samples: int = WINDOW_SAMPLES, rate: int = SAMPLE_RATE, policy: str = "wide") -> DataFrame:
    """(path, sha256, samples, problem) of every file under ``path``; one row per file, bad files with their reason.

    Spark's scan leaves out files of no bytes.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.sha2("content", 256).alias("sha256"), decode(samples, rate, policy)("content").alias("d"))
    return rows.select("path", "sha256", "d.samples", "d.problem")
