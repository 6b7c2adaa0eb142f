"""Codes of vectors: four codebooks fitted by Hamerly's form of Lloyd's rounds, in exact integers.

A vector's components become floor(1024 * x) and are cut into ``PARTS`` equal parts. Each part position has a codebook of
``ENTRIES`` integer vectors, seeded by the vectors of smallest id. A round assigns every part to its nearest entry, ties to
the lower index, and moves the entries to the floored means of their parts.

Every row keeps, from round to round, its codes and for each part one upper bound of the distance to its own entry and one
lower bound of the distance to the second-nearest. When entries move, the bounds are widened by how far; only where the
upper bound isn't strictly below the lower one (or below half the way from the own entry to its nearest neighbour), the
distance to the own entry is recomputed, and only where that doesn't help either are all entries scanned, in integers. Bounds are
rounded outwards, so that a skipped part has one nearest entry for certain: codes are those of a full scan.

Sums of a round are added up in the tasks and then by Spark; codebooks, whose size is fixed, come to the driver.

Cases: rows whose vector is null or holds null or non-finite components are dropped; of equal ids the smaller vector is
the earlier seed, null ids seed last; with fewer rows than entries the codebooks are smaller; vectors of another length than
that of the first seed, or of a length that four doesn't divide, keep a null code and error; components beyond 2**30 /
sqrt(length) are cut to that, so that distances fit 64 bits; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.llm.common import spread
from echoline.session import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
SLOP = 1e-9


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of ``width`` components as rows of integers floor(SCALE * x)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    most = isqrt((1 << 60) // width)
    return np.clip(np.floor(flat * SCALE), -most, most).astype(np.int64).reshape(-1, width)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all of ``c``; through a product of floats where that is exact."""
    most = 2 * max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if x.shape[1] * most * most < 1 << 52:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, entry in enumerate(c):
        out[:, j] = ((x - entry) ** 2).sum(axis=1)
    return out


def own_squares(x: np.ndarray, c: np.ndarray, code: np.ndarray) -> np.ndarray:
    return ((x - c[code]) ** 2).sum(axis=1)


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, upper bound, lower bound) by a full scan; the lower index wins ties."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    d = squares(x, c)
    code, every = d.argmin(axis=1), np.arange(len(x))
    near = d[every, code]
    d[every, code] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(axis=1).astype(np.float64)) if len(c) > 1 else np.full(len(x), np.inf)
    return code, np.sqrt(near.astype(np.float64)) * (1 + SLOP), second * (1 - SLOP)


def half_gaps(c: np.ndarray) -> np.ndarray:
    """Half the distance of each entry to its nearest other one, rounded down."""
    if len(c) < 2:
        return np.full(len(c), np.inf)
    d = squares(c, c)
    np.fill_diagonal(d, np.iinfo(np.int64).max)
    return np.sqrt(d.min(axis=1).astype(np.float64)) / 2 * (1 - SLOP)


def assign(x: np.ndarray, c: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New codes and bounds after the entries ``moved``, and how many rows took a full scan."""
    if not len(x):
        return code, upper, lower, 0
    by_size = np.argsort(moved)
    farthest = by_size[-1]
    other = np.where(code == farthest, moved[by_size[-2]] if len(moved) > 1 else 0.0, moved[farthest])
    upper = (upper + moved[code]) * (1 + SLOP)
    lower = np.maximum(lower - other, 0) * (1 - SLOP)
    safe = np.maximum(lower, gaps[code])
    open_ = np.flatnonzero(~(upper < safe))
    upper[open_] = np.sqrt(own_squares(x[open_], c, code[open_]).astype(np.float64)) * (1 + SLOP)
    open_ = open_[~(upper[open_] < safe[open_])]
    code = code.copy()
    code[open_], upper[open_], lower[open_] = scan(x[open_], c)
    return code, upper, lower, len(open_)


def moves(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return np.sqrt(((before - after) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLOP)


STATE = "vec_id long, label int, ints array<int>, code binary, upper array<float>, lower array<float>"


def _lists(flat: np.ndarray, width: int, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, width, np.int32)), pa.array(flat.ravel(), kind))


def _outwards(x: np.ndarray, towards: float) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(towards))


def _parts(ints: np.ndarray) -> list[np.ndarray]:
    return np.split(ints, PARTS, axis=1)


def _state(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(integers, codes, upper, lower) of a batch of states, one column per part."""
    n = b.num_rows
    ints = b.column("ints").flatten().to_numpy().astype(np.int64).reshape(n, width)
    code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, PARTS).astype(np.int64)
    bounds = [b.column(c).flatten().to_numpy().astype(np.float64).reshape(n, PARTS) for c in ("upper", "lower")]
    return ints, code, *bounds


def _kept(b: pa.RecordBatch, ints: np.ndarray, found: list) -> pa.RecordBatch:
    code = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
    upper, lower = (np.stack([f[k] for f in found], axis=1) for k in (1, 2))
    columns = [
        b.column("vec_id"), b.column("label"), _lists(ints, ints.shape[1], pa.int32()), pa.array([r.tobytes() for r in code], pa.binary()),
        _lists(_outwards(upper, np.inf), PARTS, pa.float32()), _lists(_outwards(lower, -np.inf), PARTS, pa.float32()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "ints", "code", "upper", "lower"])


def started(vectors: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """States after the first assignment, a full scan."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                ints = integers(b.column("embedding"), width)
                yield _kept(b, ints, [scan(x, c) for x, c in zip(_parts(ints), books, strict=True)])

    return vectors.mapInArrow(run, STATE)


def advanced(state: DataFrame, books: np.ndarray, before: np.ndarray, width: int) -> DataFrame:
    """States after the books moved from ``before``."""

    def run(batches):
        moved, gaps = [moves(p, c) for p, c in zip(before, books, strict=True)], [half_gaps(c) for c in books]
        for b in batches:
            if b.num_rows:
                ints, code, upper, lower = _state(b, width)
                yield _kept(b, ints, [assign(x, books[p], code[:, p], upper[:, p], lower[:, p], moved[p], gaps[p])[:3] for p, x in enumerate(_parts(ints))])

    return state.mapInArrow(run, STATE)


def updated(state: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """Floored means of the parts of each entry; entries without parts stay. Tasks hand on one sum per used entry."""
    part = width // PARTS

    def run(batches):
        n, sums = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, part), np.int64)
        for b in batches:
            if b.num_rows:
                ints, code, _, _ = _state(b, width)
                for p, x in enumerate(_parts(ints)):
                    order = np.argsort(code[:, p], kind="stable")
                    used, first = np.unique(code[order, p], return_index=True)
                    n[p] += np.bincount(code[:, p], minlength=ENTRIES)
                    sums[p, used] += np.add.reduceat(x[order], first, axis=0)
        seat = np.flatnonzero(n.ravel())
        if len(seat):
            yield pa.RecordBatch.from_arrays([pa.array(seat), pa.array(n.ravel()[seat]), _lists(sums.reshape(-1, part)[seat], part, pa.int64())], ["seat", "n", "sums"])

    found = state.select("ints", "code", "upper", "lower").mapInArrow(run, "seat long, n long, sums array<long>")
    total = found.groupBy("seat").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(part))).alias("sums"))
    books = books.copy()
    for r in total.collect():
        books[r["seat"] // ENTRIES, r["seat"] % ENTRIES] = [x // r["n"] for x in r["sums"]]
    return books


def coded(state: DataFrame, books: np.ndarray, before: np.ndarray, width: int) -> DataFrame:
    """(vec_id, label, code as hex, error) after the last assignment."""

    def run(batches):
        moved, gaps = [moves(p, c) for p, c in zip(before, books, strict=True)], [half_gaps(c) for c in books]
        for b in batches:
            if b.num_rows:
                ints, code, upper, lower = _state(b, width)
                error = np.zeros(b.num_rows, np.int64)
                for p, x in enumerate(_parts(ints)):
                    code[:, p] = assign(x, books[p], code[:, p], upper[:, p], lower[:, p], moved[p], gaps[p])[0]
                    error += own_squares(x, books[p], code[:, p])
                text = [r.tobytes().hex() for r in code.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return state.mapInArrow(run, "vec_id long, label int, code string, error long")


def finite(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of rows whose vector is whole."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding").filter(F.col("embedding").isNotNull() & whole)


def fit(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame | None, np.ndarray, np.ndarray, int]:
    """(states of the last round, codebooks, codebooks before, vector length) of ``finite`` rows."""
    seeds = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").toArrow().column("embedding").combine_chunks()
    width = len(seeds[0]) if len(seeds) else 0
    if width == 0 or width % PARTS:
        return None, np.zeros((0, 0, 0), np.int64), np.zeros((0, 0, 0), np.int64), 0
    alike = seeds.filter(pa.compute.equal(pa.compute.list_value_length(seeds), width))
    books = np.stack(_parts(integers(alike, width)))
    state = None
    rows = vectors.filter(F.size("embedding") == width)
    before = books
    for _ in range(rounds):
        state = stored(started(rows, books, width) if state is None else advanced(state, books, before, width), "codes-state")
        before, books = books, updated(state, books, width)
    return state, books, before, width


def codes(vectors: DataFrame) -> DataFrame:
    """One row per whole vector: vec_id, code, error, label_error, codebooks_sha256."""
    whole = finite(vectors)
    state, books, before, width = fit(whole)
    out = whole.filter((F.size("embedding") != width) | F.lit(width == 0)).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if state is not None:
        out = coded(state, books, before, width).unionByName(out)
    out = stored(out.withColumn("__key", F.concat_ws("", F.lit("="), F.col("label").cast("string"))), "codes")
    sums = out.groupBy("__key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__n"))
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    named = spread(out, sums, "__key", "__n", "vec_id")
    return named.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
