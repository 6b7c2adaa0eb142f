"""Resampled groups, fitted controls and the choice among candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoline.operators import metrics, ranking


def resampled(rows: DataFrame, drawn: DataFrame) -> DataFrame:
    """Rows of drawn groups; each copy is a group of its own, ``group#k``."""
    return drawn.join(rows, "group_id").withColumn("group_id", F.concat_ws("#", "group_id", "k"))


def stratified_draws(groups: DataFrame, n_draws: int, seed: str) -> DataFrame:
    """As ``metrics.draws``, but each class is drawn from its own groups and keeps its size."""
    return metrics.draws(groups, n_draws, seed, ["y"])


def paired_delta(groups: DataFrame, drawn: DataFrame, a: str = "p", b: str = "p_b") -> DataFrame:
    """One row (observed, low, high, draws, verdict): AUC of score ``a`` less that of ``b`` over the groups, and over the same draws.

    Draws (draw, k, group_id) of one class have no difference and are left out of the interval and of the count.
    """
    both = F.explode(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(a, b))).alias("run", "p")
    delta = lambda rows, by: metrics.roc_auc(rows, [*by, "run"]).groupBy(*by).pivot("run", ["a", "b"]).agg(F.first("roc_auc")).withColumn("delta", F.col("a") - F.col("b"))
    observed = delta(groups.select(F.lit(0).alias("one"), "y", both), ["one"]).select(F.col("delta").alias("observed"))
    ci = metrics.interval(delta(drawn.join(groups, "group_id").select("draw", "y", both), ["draw"]).select("draw", "delta"), "delta")
    return observed.crossJoin(ci).withColumn("verdict", metrics.verdict(F.col("low"), F.col("high")))  # one row each


def promoted(gain: Column, low: Column, least: float) -> Column:
    """A candidate is promoted if it gains at least so much and its interval lies above 0."""
    return F.coalesce((gain >= least) & (low > 0), F.lit(False))


def standardisation(rows: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, one row in the driver; a deviation of 0 counts as 1."""
    r = rows.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).first()
    return {n: (r[f"m_{n}"], r[f"s_{n}"] or 1.0) for n in names}


def fit_logistic(rows: DataFrame, names: list[str], c: float = 1.0) -> dict:
    """Coefficients of an L2-penalised logistic regression of y on z-scores, with inverse strength ``c``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    scale = standardisation(rows, names)
    z = rows.select(F.col("y").cast("double").alias("label"), *[((F.col(n) - m) / s).alias(n) for n, (m, s) in scale.items()])
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(z)
    fitted = LogisticRegression(regParam=1 / (c * vectors.count()), standardization=False, maxIter=200, tol=1e-10).fit(vectors)
    return {"scale": scale, "weights": dict(zip(names, map(float, fitted.coefficients), strict=True)), "intercept": float(fitted.intercept)}


def scored(model: dict) -> Column:
    """Probability of a fitted model as an expression, without any function in Python."""
    z = reduce(lambda acc, n: acc + (F.col(n) - model["scale"][n][0]) / model["scale"][n][1] * model["weights"][n], model["weights"], F.lit(model["intercept"]))
    return 1 / (1 + F.exp(-z))


def out_of_fold(rows: DataFrame, names: list[str], folds: int, c: float = 1.0, seed: str = "seed") -> DataFrame:
    """``rows`` (clip_id, group_id, y and features) with cv_fold and p of the model that did not see the row's fold."""
    dealt = rows.join(ranking.grouped_folds(rows, folds, seed).select("group_id", "cv_fold"), "group_id")
    models = [fit_logistic(dealt.filter(F.col("cv_fold") != f), names, c) for f in range(folds)]
    return dealt.withColumn("p", F.coalesce(*[F.when(F.col("cv_fold") == f, scored(m)) for f, m in enumerate(models)]))


def grid(rows: DataFrame, names: list[str], folds: int, strengths: list[float]) -> DataFrame:
    """(c, mean_auc): mean of the folds' AUC of group medians, for each inverse strength; folds of one class are left out."""
    parts = []
    for c in strengths:
        groups = metrics.group_medians(out_of_fold(rows, names, folds, c), ["cv_fold"])
        parts.append(metrics.roc_auc(groups, ["cv_fold"]).agg(F.avg("roc_auc").alias("mean_auc")).select(F.lit(c).alias("c"), "mean_auc"))
    return reduce(DataFrame.unionByName, parts)


def choose(candidates: DataFrame, score: str, order: str) -> DataFrame:
    """The row of the largest score; the least ``order`` on a tie. Undefined scores are never chosen."""
    return candidates.filter(F.col(score).isNotNull()).orderBy(F.desc(score), order).limit(1)


def score_spread(routes: DataFrame, threshold: float = 0.5, tolerance: float = 1e-6) -> DataFrame:
    """Of (clip_id, route, p): one row with clips, clips beyond the tolerance, changed decisions, the largest spread and its clip."""
    per = routes.groupBy("clip_id").agg((F.max("p") - F.min("p")).alias("spread"), (F.max("p") >= threshold).alias("hi"), (F.min("p") >= threshold).alias("lo"))
    return per.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("spread") > tolerance).alias("beyond"), F.count_if(F.col("hi") != F.col("lo")).alias("flips"),
        F.max("spread").alias("largest"), F.min(F.struct((-F.col("spread")).alias("s"), "clip_id"))["clip_id"].alias("worst"),
    )


def first_divergence(stages: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Of (clip_id, stage, a, b): each clip's first stage at which the two routes' arrays differ, and by how much."""
    gap = F.aggregate(F.zip_with("a", "b", lambda u, v: F.abs(u - v)), F.lit(0.0), lambda acc, v: F.greatest(acc, v))
    unequal = stages.withColumn("gap", F.when(F.size("a") != F.size("b"), float("inf")).otherwise(gap)).filter(F.col("gap") > tolerance)
    return unequal.groupBy("clip_id").agg(F.min("stage").alias("stage"), F.min_by("gap", "stage").alias("gap"))
