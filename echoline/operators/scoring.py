"""Scoring by a callback that sees samples only: no ids, labels or paths reach it, and its model is built once in a worker.

``build`` makes the scorer: a function from an array (rows, samples) to as many scores in [0, 1]. It is called where scoring happens,
once for each Python worker and call of an operator here, however many tasks and batches the worker runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.operators import evaluation
from echoline.operators.grouped import runs_of

Scorer = Callable[[np.ndarray], np.ndarray]
#: Windows of a recording, their samples, and how many measures stand beside a window's score.
WINDOWS, SAMPLES, MEASURES = 30, 8000, 9
#: What an input of a model may have; everything else stays outside.
ALLOWED = ("samples",)

_BUILT: dict[str, Scorer] = {}


def only(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` if they have exactly the allowed input columns; a column more or less is refused by name."""
    more, less = sorted(set(rows.columns) - set(names)), sorted(set(names) - set(rows.columns))
    if more or less:
        raise ValueError("input columns not allowed: " + ", ".join(more) if more else "input columns missing: " + ", ".join(less))
    return rows.select(*names)


def _scorer(token: str, build: Callable[[], Scorer]) -> Scorer:
    from echoline.operators import scoring as home  # the worker's own module: a function may come as a copy, with globals of its own

    if token not in home._BUILT:
        home._BUILT.clear()  # models of earlier calls
        home._BUILT[token] = build()
    return home._BUILT[token]


def checked(scorer: Scorer, x: np.ndarray) -> np.ndarray:
    """The scores of rows; a scorer that leaves out or adds one, or gives anything but numbers in [0, 1], is refused."""
    p = np.asarray(scorer(x), float).reshape(-1)
    if len(p) != len(x):
        raise ValueError(f"the scorer gave {len(p)} scores for {len(x)} inputs")
    if not (np.isfinite(p).all() and ((p >= 0) & (p <= 1)).all()):
        raise ValueError("the scorer gave a score outside [0, 1]")
    return p


def _matrix(column: pa.Array, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are whole: so many finite samples, these rows as a matrix)."""
    sizes = pa.compute.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(sizes == samples)
    x = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(good), samples)
    whole = np.isfinite(x).all(axis=1)
    return good[whole], x[whole]


def scored(rows: DataFrame, build: Callable[[], Scorer], key: str = "clip_id", samples: int = SAMPLES) -> DataFrame:
    """(key, p, problem) of (key, samples): batch by batch; signals of another length or with broken samples have the problem instead."""
    token, kind = uuid.uuid4().hex, dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, x = _matrix(b.column("samples"), samples)
                p = np.full(b.num_rows, np.nan)
                if len(at):
                    p[at] = checked(_scorer(token, build), x)
                lost = np.isnan(p)
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(p, mask=lost), pa.array(np.where(lost, "input", None), pa.string())], [key, "p", "problem"])

    return only(rows, key, *ALLOWED).mapInArrow(run, f"{key} {kind}, p double, problem string")


def by_routes(rows: DataFrame, build: Callable[[], Scorer], sizes: tuple[int, ...] = evaluation.BATCH_SIZES) -> DataFrame:
    """(clip_id, route, p): every clip scored in real batches of each size, in the order of the ids and in its reverse.

    A batch is one call of the scorer, with its clips in their places; ids are put back beside the scores outside of it.
    """
    token, kind = uuid.uuid4().hex, dict(rows.dtypes)["clip_id"]
    dealt = evaluation.batched(only(rows, "clip_id", *ALLOWED), sizes)
    sorted_rows = dealt.repartition("route", "batch").sortWithinPartitions("route", "batch", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs_of(batches, ["route", "batch"]):
            x = np.stack([np.asarray(s, float) for s in g.column("samples").to_pylist()])
            p = checked(_scorer(token, build), x)
            yield pa.RecordBatch.from_arrays([g.column("clip_id").combine_chunks(), g.column("route").combine_chunks(), pa.array(p)], ["clip_id", "route", "p"])

    return sorted_rows.mapInArrow(run, f"clip_id {kind}, route string, p double")


def recording_matrix(recordings: DataFrame, build: Callable[[], tuple[Scorer, Scorer]], key: str = "recording", windows: int = WINDOWS, samples: int = SAMPLES) -> DataFrame:
    """(key, matrix, problem): each recording's windows in order as rows of their measures and their score.

    ``build`` gives (measure, score): windows (n, samples) to measures (n, k), and measures to scores. A recording of
    another length, or with broken samples, has the problem and no matrix.
    """
    token, kind = uuid.uuid4().hex, dict(recordings.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, x = _matrix(b.column("samples"), windows * samples)
                out: list = [None] * b.num_rows
                if len(at):
                    measure, score = _scorer(token, build)
                    m = np.asarray(measure(x.reshape(-1, samples)), float)
                    both = np.column_stack([m, checked(score, m)])
                    for i, rows in zip(at.tolist(), both.reshape(len(at), windows, -1), strict=True):
                        out[i] = rows.tolist()
                problem = [None if o is not None else "input" for o in out]
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, pa.list_(pa.list_(pa.float64()))), pa.array(problem, pa.string())], [key, "matrix", "problem"])

    return only(recordings, key, *ALLOWED).mapInArrow(run, f"{key} {kind}, matrix array<array<double>>, problem string")


def verified(recordings: DataFrame, files: DataFrame, partition: str) -> DataFrame:
    """(recording, label, samples) of one partition, from (recording, path, sha256, label, partition) and files (path, content) of doubles.

    A recording whose file is missing or has another SHA-256 fails the whole load with its name.
    """
    from echoline.operators.audit import check, enforce

    rows = recordings.filter(F.col("partition") == partition)
    read = rows.join(files.select("path", "content", F.sha2("content", 256).alias("__found")), "path", "left")
    enforce(check(read, f"files of {partition} as declared", ~F.coalesce(F.col("__found") == F.col("sha256"), F.lit(False))))

    @F.pandas_udf("array<double>")
    def doubles(content):
        return content.map(lambda c: np.frombuffer(c, "<f8") if len(c) % 8 == 0 else None)

    return read.select("recording", "label", doubles("content").alias("samples"))
