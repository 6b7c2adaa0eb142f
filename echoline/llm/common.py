"""What several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, part: str, bucket: str, order: list[str], value: str, out: str, totals: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in ``part``, by (bucket, order).

    No task holds a whole ``part``: sums inside (part, bucket) come from one window, and the sums of the
    buckets before from a second window over one row per bucket. ``totals`` may give the same rows from a
    cheaper scan. ``part`` and ``bucket`` must not be null.
    """
    sums = (df if totals is None else totals).groupBy(part, bucket).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(part, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(part, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(base, [part, bucket])
        .withColumn(out, F.col("__base") + F.col("__in"))
        .drop("__base", "__in")
    )


#: Bytes of text that a scan takes at a time: intermediate arrays are many times as large.
STEP = 1 << 18


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (UTF-8 bytes, offsets of n + 1), nulls as empty texts; no copy when there are no nulls."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[at : at + n + 1] if n else np.zeros(1, np.int64)
    if data is None or not len(offsets) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows [i, j) of at most ``limit`` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser over uint64 with full avalanche (shifts and odd multipliers, wrapping)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def row_hash(rows: DataFrame):
    """A hash of all columns of a row, maps left out."""
    names = [f.name for f in rows.schema.fields if f.dataType.typeName() != "map"]
    return F.xxhash64(*[F.col(f"`{n}`") for n in names])


def rows_of(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Join ``docs`` to ``found`` on doc_id and ``th``, the hash of the text, nulls equal; adds ``__th``."""
    left = docs.withColumn("__th", F.xxhash64("text"))
    right = found.withColumnsRenamed({"doc_id": "__id", "th": "__of"})
    out = left.join(right, left["doc_id"].eqNullSafe(right["__id"]) & (left["__th"] == right["__of"]), how)
    return out.drop("__id", "__of")


def spread(rows: DataFrame, keys: DataFrame, on: str, n: str, by: str, how: str = "inner", parts: int = 64, most: int = 10_000, least: int = 1000) -> DataFrame:
    """Join ``rows`` to ``keys`` (one row per ``on``; ``n``: how many rows have it), hot keys over ``parts`` tasks each.

    A key is hot from a ``most``-th of all rows on, and from ``least`` rows: so there are at most ``most`` hot keys, and
    their list may be broadcast. Rows of a hot key are dealt by a hash of ``by``; its row in ``keys`` goes to every part.
    """
    total = keys.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = F.col(n) > max(least, total // most)
    marks = F.broadcast(keys.filter(hot).select(F.col(on), F.lit(True).alias("__hot")))
    left = rows.join(marks, on, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(parts))).otherwise(F.lit(0).cast("long"))).drop("__hot")
    right = keys.withColumn("__salt", F.explode(F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))).drop(n)
    return left.join(right, [on, "__salt"], how).drop("__salt")
