"""Expressions around outside models: their histories, their answers' grammar, their scores, and reasons to fall back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echoline.functions.config import HISTORY
from echoline.functions.series import BAND_NAMES

#: Columns of a history row, where its score stands, and how far normalised values go.
WIDTH, SCORE, CLIP = 10, 9, 10.0
#: Fixed value: what an answer must look like.
ANSWER = rf"^(leak|no_leak); Greatest mean spectral energy: ({'|'.join(BAND_NAMES)}) Hz\.$"


def history_problem(history: Column) -> Column:
    """Why a history (rows of 10 numbers, the last a score) can't be used, or null."""
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return (
        F.when(history.isNull() | ~F.size(history).between(1, HISTORY), "length")
        .when(F.exists(history, lambda row: row.isNull() | (F.size(row) != WIDTH)), "width")
        .when(F.exists(history, lambda row: F.exists(row, lambda v: ~number(v))), "not_finite")
        .when(F.exists(history, lambda row: ~F.get(row, F.lit(SCORE)).between(0, 1)), "score")
    )


def padded(history: Column, mean: list[float], scale: list[float]) -> Column:
    """Normalised rows, clipped to +-10, after as many rows of zeros as fill the history to 64."""
    m, s = (F.array(*map(F.lit, v)) for v in (mean, scale))
    row = lambda r: F.transform(r, lambda v, i: F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (v - F.get(m, i)) / F.get(s, i))))
    zero = F.array_repeat(F.lit(0.0), len(mean))
    return F.concat(F.array_repeat(zero, F.lit(HISTORY) - F.size(history)), F.transform(history, row))


def answer(text: Column) -> Column:
    """Struct (label, band, problem) of a model's text; no class is put in place of one that can't be read."""
    label, band = (F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), ANSWER, i), F.lit("")) for i in (1, 2))
    return F.struct(label.alias("label"), band.alias("band"), F.when(text.isNull(), "missing").when(label.isNull(), "grammar").alias("problem"))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda v: F.exp(v - top))
    return F.transform(powers, lambda v: v / F.aggregate(powers, F.lit(0.0), lambda acc, u: acc + u))


def best(scores: Column, names: Column) -> Column:
    """Name of the largest score; the first on a tie."""
    return F.get(names, (F.array_position(scores, F.array_max(scores)) - 1).cast("int"))


def fallback_reasons(text: Column, decision: Column, measured_band: Column, p: Column) -> Column:
    """Why a text can't be shown beside its measurement, in a fixed order; empty if it can."""
    a = answer(text)
    reasons = (
        ("no_score", p.isNull() | F.isnan(p) | ~p.between(0, 1)), ("no_text", text.isNull()), ("grammar", text.isNotNull() & a["label"].isNull()),
        ("class_differs", a["label"] != decision), ("band_differs", a["band"] != measured_band),
    )
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons]), lambda r: r.isNotNull())


def class_scores(p: Column) -> Column:
    return F.create_map(F.lit("leak"), p, F.lit("no_leak"), 1 - p)
