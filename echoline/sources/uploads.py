"""Uploaded WAV files of several formats as a table, with an id from their content, warnings, and the reason why one can't be used.

A parser of RIFF chunks reads PCM of 16, 24 and 32 bits and 32-bit floats, mono and stereo, with plain and extensible headers.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes and seconds of an upload, its sample rates, and the warnings' texts.
MAX_BYTES, MAX_SECONDS = 8 * 1024 * 1024, 30
RATES = (8000, 192000)
SILENT = "Silent signal: no measurable acoustic energy."
FULL_SCALE = "Full-scale amplitude or above: check for clipping."
#: Fixed values of the format: tags of PCM, floats and extensible headers, and the end of the id that an extensible header names a tag by.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
SUBFORMAT = bytes.fromhex("000000001000800000aa00389b71")
AUDIO = "sample_id string, input_sha256 string, sample_rate_hz int, channels int, duration_seconds double, waveform array<float>, warnings array<string>, problem string"
NAMES = [x.split(" ")[0] for x in AUDIO.split(", ")]


class Refused(ValueError):
    """Why an upload can't be used."""


def chunks(data: bytes) -> dict[bytes, bytes]:
    """The first chunk of each name; one that the file ends in is cut there."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise Refused("not_wav")
    found, at = {}, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        found.setdefault(name, body)
        if name == b"data" and len(body) < size:
            found[b"short"] = b""
        at += 8 + size + size % 2
    return found


def samples(raw: bytes, tag: int, bits: int) -> np.ndarray:
    """Interleaved samples as 32-bit floats, integers scaled to [-1, 1)."""
    if tag == FLOAT:
        return np.frombuffer(raw, "<f4")
    if bits == 24:
        three = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        whole = np.zeros((len(three), 4), np.uint8)
        whole[:, 1:] = three
        return (whole.view("<i4")[:, 0] / 2.0**31).astype(np.float32)
    return (np.frombuffer(raw, f"<i{bits // 8}") / 2.0 ** (bits - 1)).astype(np.float32)


def parsed(data: bytes) -> tuple[int, int, np.ndarray]:
    """(rate, channels, interleaved samples) of an upload, or ``Refused``."""
    found = chunks(data)
    header, body = found.get(b"fmt "), found.get(b"data")
    if header is None or body is None or len(header) < 16:
        raise Refused("not_wav")
    tag, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", header)
    if tag == EXTENSIBLE:
        if len(header) < 40 or header[26:40] != SUBFORMAT:
            raise Refused("subtype")
        tag = struct.unpack_from("<H", header, 24)[0]
    if (tag, bits) not in ((PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32)):
        raise Refused("subtype")
    if channels not in (1, 2):
        raise Refused("channels")
    if not RATES[0] <= rate <= RATES[1]:
        raise Refused("sample_rate")
    if block != channels * bits // 8:
        raise Refused("not_wav")
    if b"short" in found or len(body) % block:
        raise Refused("truncated")
    if not 0 < len(body) <= rate * MAX_SECONDS * block:
        raise Refused("duration")
    x = samples(body, tag, bits)
    if not np.isfinite(x).all():
        raise Refused("not_finite")
    return rate, channels, x


def audio(data: bytes | None) -> tuple:
    """An upload's row: its ids, properties, interleaved samples and warnings, or the problem alone."""
    try:
        if not data:
            raise Refused("missing" if data is None else "not_wav")
        if len(data) > MAX_BYTES:
            raise Refused("too_large")
        rate, channels, x = parsed(data)
    except Refused as reason:
        return (*[None] * (len(NAMES) - 1), str(reason))
    digest = hashlib.sha256(f"{rate}:{channels}:".encode() + x.astype("<f4").tobytes()).hexdigest()
    warnings = ([] if x.any() else [SILENT]) + ([FULL_SCALE] if np.abs(x).max() >= 1 else [])
    return digest[:24], digest, rate, channels, len(x) / channels / rate, x, warnings, None


def decode():
    """A pandas UDF from the bytes of an upload to a struct of ``AUDIO``."""

    @F.pandas_udf(AUDIO)
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([audio(x) for x in content], columns=NAMES).astype({"sample_rate_hz": "Int32", "channels": "Int32"})

    return run


def mono(waveform, channels):
    """Mean of the channels of interleaved samples, in double precision, for display."""
    at = lambda i, c: F.get(waveform, (i * channels + c).cast("int")).cast("double")
    frames = F.sequence(F.lit(0), (F.size(waveform) / channels).cast("int") - 1)
    return F.when(channels == 1, waveform.cast("array<double>")).otherwise(F.transform(frames, lambda i: (at(i, 0) + at(i, 1)) / 2))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, ...) of ``AUDIO`` for every file under ``path``; files that are too large are told by their length and not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = F.lower(F.element_at(F.split("path", r"\."), -1)) == "wav"
    sound = files.filter(F.col("length") <= MAX_BYTES).select("path", F.when(named, decode()("content")).alias("a"), named.alias("wav"))
    read = sound.select("path", *[F.col(f"a.{n}").alias(n) for n in NAMES[:-1]], F.when(~F.col("wav"), "extension").otherwise(F.col("a.problem")).alias("problem"))
    large = files.filter(F.col("length") > MAX_BYTES).select("path", F.lit("too_large").alias("problem"))
    return read.unionByName(large, allowMissingColumns=True)


def kept(uploads: DataFrame) -> DataFrame:
    """One upload for each content, that of the least path, with how often it was sent; unusable ones are left out."""
    first = uploads.filter("problem is null").groupBy("sample_id").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("sent"))
    return uploads.join(first, ["sample_id", "path"])
