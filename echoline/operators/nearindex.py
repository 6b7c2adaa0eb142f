"""Near pairs of vectors through random hyperplanes: an index that copies each vector a fixed number of times, verified exactly.

A vector's sketch holds the sides it takes of ``tables * bits`` hyperplanes; each run of ``bits`` of them is a key of a table.
Two vectors meet if they share a key of any table. There, sketches that differ in far too many places for the wanted cosine are
dropped, and what is left is decided by the exact cosine of the vectors themselves. So a pair that is told is a pair; how many
are missed follows from ``tables`` and ``bits`` by ``missed``, and ``overlap.near_pairs`` compares all with all.

Only sketches travel to the buckets. A bucket of more than ``PART`` sketches is cut into parts, and each pair of its parts is a group of
its own: no task holds more than two parts. Equal vectors stand for each other: one of them is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.operators.grouped import runs_of

#: Rows of a part of a bucket; standard deviations of the differing places that a pair at the wanted cosine may be off.
PART, SLACK = 2048, 5.0
FIXED_SEED = 20260912


def missed(cosine: float, tables: int, bits: int) -> float:
    """The chance that a pair of this cosine shares no key."""
    return (1 - (1 - acos(cosine) / pi) ** bits) ** tables


def tables_for(cosine: float, bits: int, miss: float = 1e-4) -> int:
    """Tables that are needed to miss a pair at the cosine with at most this chance."""
    return ceil(log(miss) / log(1 - (1 - acos(cosine) / pi) ** bits))


def spectrum_means(vectors: DataFrame, column: str = "x") -> np.ndarray:
    """Mean of each component over all rows: tasks hand on one sum per component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            x = b.column(0).drop_null()
            if len(x):
                rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                total, n = rows.sum(axis=0) + (0 if total is None else total), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.float64()), pa.array([n] * len(total), pa.int64())], ["i", "s", "n"])

    sums = vectors.select(column).mapInArrow(run, "i int, s double, n long").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m"))
    found = {r["i"]: r["m"] for r in sums.collect()}
    return np.array([found[i] for i in range(len(found))])


def double_centred(vectors: DataFrame) -> DataFrame:
    """(id, x) with the mean of each component, then the mean of each row, taken off and length 1; null vectors are left out."""
    means = spectrum_means(vectors)
    kind = dict(vectors.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) - means
                x = x - x.mean(axis=1, keepdims=True)
                x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
                ends = pa.array(np.arange(0, x.size + 1, x.shape[1], np.int32))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["id", "x"])

    return vectors.select("id", "x").filter("x is not null").mapInArrow(run, f"id {kind}, x array<double>")


def sketched(vectors: DataFrame, tables: int, bits: int) -> DataFrame:
    """(id, sketch binary) of (id, x): a bit per hyperplane, whose normals are drawn from a fixed seed."""
    kind = dict(vectors.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                if planes is None:
                    planes = np.random.default_rng(FIXED_SEED).standard_normal((x.shape[1], tables * bits))
                packed = np.packbits(x @ planes > 0, axis=1)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in packed], pa.binary())], ["id", "sketch"])

    return vectors.mapInArrow(run, f"id {kind}, sketch binary")


def keyed(sketches: DataFrame, tables: int, bits: int) -> DataFrame:
    """(id, sketch, bucket): a row for each table, the bucket being the table and its bits of the sketch."""
    kind = dict(sketches.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                sides = np.unpackbits(raw, axis=1)[:, : tables * bits].reshape(b.num_rows, tables, bits)
                key = (sides.astype(np.int64) << np.arange(bits)).sum(axis=2) + (np.arange(tables, dtype=np.int64) << 32)
                row = pa.array(np.repeat(np.arange(b.num_rows), tables))
                yield pa.RecordBatch.from_arrays([b.column("id").take(row), b.column("sketch").take(row), pa.array(key.ravel())], ["id", "sketch", "bucket"])

    return sketches.mapInArrow(run, f"id {kind}, sketch binary, bucket long")


def candidates(sketches: DataFrame, cosine: float, tables: int, bits: int, part: int = PART) -> DataFrame:
    """(a, b), a < b: pairs that share a key and whose sketches are near enough, each once."""
    kind = dict(sketches.dtypes)["id"]
    rows = keyed(sketches, tables, bits)
    size = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = size.withColumn("parts", F.ceil(F.col("n") / part).cast("int")).select("bucket", "parts")
    # Most buckets have one part; only rows of larger ones go to several groups.
    dealt = rows.join(parts, "bucket").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "sketch")
    sorted_rows = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    p, n = acos(cosine) / pi, tables * bits
    most = n * p + SLACK * sqrt(n * p * (1 - p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs_of(batches, ["bucket", "i", "j"]):
            ids, mine = g.column("id").to_numpy(), g.column("mine").to_numpy()
            own, cross = int(g.column("i")[0].as_py()), int(g.column("j")[0].as_py())
            bits_of = np.unpackbits(np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1), axis=1)[:, :n].astype(np.float32)
            left, right = (np.flatnonzero(mine == own), np.flatnonzero(mine == cross)) if own != cross else (np.arange(len(ids)),) * 2
            ones = bits_of.sum(axis=1)
            differ = ones[left][:, None] + ones[right][None, :] - 2 * (bits_of[left] @ bits_of[right].T)
            u, v = np.nonzero(differ <= most)
            a, b = ids[left[u]], ids[right[v]]
            keep = a < b if own == cross else a != b
            a, b = a[keep], b[keep]
            if len(a):
                low = a < b
                yield pa.RecordBatch.from_arrays([pa.array(np.where(low, a, b)), pa.array(np.where(low, b, a))], ["a", "b"])

    return sorted_rows.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def near_pairs(vectors: DataFrame, over: float, bits: int = 8, tables: int | None = None, part: int = PART) -> DataFrame:
    """(a, b, cosine) of pairs of (id, x) with a < b whose cosine is above ``over``: found by the index, decided exactly.

    Equal vectors are told as pairs of their least id with each other one; other pairs hold for their least ids.
    """
    tables = tables or tables_for(over, bits)
    digest = F.sha2(F.array_join(F.transform("x", lambda v: (v + 0.0).cast("string")), ","), 256)
    marked = vectors.filter(F.exists("x", lambda v: v != 0)).withColumn("d", digest)
    least = marked.groupBy("d").agg(F.min_by("x", "id").alias("x"), F.min("id").alias("id"))
    same = marked.select("id", "d").join(least.select("d", F.col("id").alias("lead")), "d").filter("id > lead").select(F.col("lead").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine"))
    pairs = candidates(sketched(least.select("id", "x"), tables, bits), over, tables, bits, part)
    side = lambda c: least.select(F.col("id").alias(c), F.col("x").alias(f"x_{c}"))
    dot = F.aggregate(F.zip_with("x_a", "x_b", lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (dot / (norm("x_a") * norm("x_b"))).alias("cosine"))
    return met.filter(F.col("cosine") > over).unionByName(same)
