"""Array functions over signals (array<double>), as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column, f=lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + f(v))


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def moment(x: Column, k: int) -> Column:
    """Central moment of order ``k`` (population)."""
    m = mean(x)
    return total(x, lambda v: F.pow(v - m, F.lit(k))) / F.size(x)


def rms(x: Column) -> Column:
    return F.sqrt(total(x, lambda v: v * v) / F.size(x))


def level_dbfs(x: Column, full_scale: float = 32768.0) -> Column:
    return 20 * F.log10(rms(x) / full_scale + F.lit(1e-12))


def rms_normalised(x: Column) -> Column:
    """Mean removed and RMS 1; a constant signal only loses its mean."""
    centred = lambda m: F.transform(x, lambda v: v - m)
    s = F.sqrt(moment(x, 2))
    return F.transform(F.array(F.struct(mean(x).alias("m"), s.alias("s"))), lambda a: F.when(a["s"] > 0, F.transform(centred(a["m"]), lambda v: v / a["s"])).otherwise(centred(a["m"])))[0]


def quality_problem(x: Column, samples: int, full_scale: float = 1.0, silent: float = 1e-10) -> Column:
    """Why a window can't be scored, or null."""
    return (
        F.when(x.isNull(), "missing").when(F.size(x) != samples, "length")
        .when(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), "not_finite")
        .when(F.exists(x, lambda v: F.abs(v) > full_scale), "out_of_range")
        .when(F.sqrt(moment(x, 2)) < silent, "silent")
    )


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays of a size, clamped; null where one is constant."""
    ma, mb = mean(a), mean(b)
    dot = F.aggregate(F.zip_with(a, b, lambda u, v: (u - ma) * (v - mb)), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(total(a, lambda v: (v - ma) * (v - ma))) * F.sqrt(total(b, lambda v: (v - mb) * (v - mb)))
    # greatest and least skip nulls, so the constant case must stay outside them.
    return F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, norm))))


def ewma(x: Column, alpha: float = 0.2) -> Column:
    """Exponentially weighted mean, started by the first value."""
    return F.aggregate(F.slice(x, 2, 1 << 30), x[0], lambda acc, v: acc * (1 - alpha) + v * alpha)


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))
