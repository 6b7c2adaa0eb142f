"""Metrics of score tables. Rows have (y 0/1, p) and usually group_id; undefined metrics are null.

Ranking metrics go through a histogram of distinct scores per key, so ties are exact and the sort sees one row
per score; ``by`` names the columns that separate reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoline.operators import ranking

#: Ranges of scores that are summed apart; tasks that make a table of draws.
RANGES, SPREAD = 256, 32


def group_medians(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row per group: its median score, class and whether it mixes classes."""
    return rows.groupBy(*by, "group_id").agg(F.median("p").alias("p"), F.max("y").alias("y"), (F.min("y") != F.max("y")).alias("mixed"), F.count(F.lit(1)).alias("n"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def metric_block(rows: DataFrame, threshold: float, by: list[str] = ()) -> DataFrame:
    """Counts and rates at ``p >= threshold``."""
    yes = F.col("p") >= threshold
    c = rows.groupBy(*by).agg(
        F.count_if((F.col("y") == 1) & yes).alias("tp"), F.count_if((F.col("y") == 0) & yes).alias("fp"),
        F.count_if((F.col("y") == 0) & ~yes).alias("tn"), F.count_if((F.col("y") == 1) & ~yes).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return c.withColumns({
        "recall": recall, "fpr": ratio(fp, tn + fp), "precision": ratio(tp, tp + fp),
        "balanced_accuracy": F.coalesce((recall + specificity) / 2, recall, specificity),
        "macro_f1": (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2,
    })


def _histogram(rows: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    w = F.lit(1) if weight is None else F.col(weight)
    return rows.groupBy(*by, "p").agg(F.sum(F.col("y") * w).cast("long").alias("pos"), F.sum((1 - F.col("y")) * w).cast("long").alias("neg"))


def _running(h: DataFrame, by: list[str], sums: dict[str, Column], descending: bool = True) -> DataFrame:
    """Add running sums by falling (or rising) score, each row's own included.

    Without ``by`` one key holds all scores: sums then run inside ``RANGES`` ranges, cut at quantiles of the distinct scores
    wherever they lie, and over the ranges' totals, so that no task sees all of them.
    """
    order = F.desc if descending else F.asc
    if by:
        w = Window.partitionBy(*by).orderBy(order("p")).rowsBetween(Window.unboundedPreceding, 0)
        return h.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    cut = h.crossJoin(F.broadcast(ranking.quantile_cuts(h, "p", RANGES)))  # one row
    h = cut.withColumn("__range", ranking.bucket_of(F.col("p"), F.col("cuts"), RANGES)).drop("cuts")
    earlier = Window.orderBy(order("__range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = h.groupBy("__range").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    totals = totals.select("__range", *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in sums])
    w = Window.partitionBy("__range").orderBy(order("p")).rowsBetween(Window.unboundedPreceding, 0)
    inside = h.withColumns({n: F.sum(c).over(w) for n, c in sums.items()}).join(totals, "__range")
    return inside.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__range", *[f"__{n}" for n in sums])


def roc_auc(rows: DataFrame, by: list[str] = (), weight: str | None = None) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties one half; ``weight`` says how often a row counts."""
    h = _running(_histogram(rows, list(by), weight), list(by), {"under": F.col("neg")}, descending=False).withColumn("under", F.col("under") - F.col("neg"))
    twice = F.sum(F.col("pos") * (2 * F.col("under") + F.col("neg")))
    return h.groupBy(*by).agg(ratio(twice, 2 * F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def average_precision(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """One step per distinct score, from the top."""
    h = _running(_histogram(rows, list(by)), list(by), {"tp": F.col("pos"), "n": F.col("pos") + F.col("neg")})
    ap = ratio(F.sum(F.col("pos") * F.col("tp") / F.col("n")), F.sum("pos"))
    return h.groupBy(*by).agg(F.when((F.sum("neg") > 0) & (F.sum("pos") > 0), ap).alias("pr_auc"))


def brier(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("brier"))


def pick_threshold(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Threshold of the best macro-F1 among the scores and just outside them; the smallest on a tie."""
    h = _histogram(rows, list(by))
    ends = h.groupBy(*by).agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    outside = ends.select(*by, F.explode(F.array(F.col("lo") - 1e-9, F.col("hi") + 1e-9)).alias("p"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    c = h.unionByName(outside).groupBy(*by, "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    c = _running(c, list(by), {"tp": F.col("pos"), "fp": F.col("neg")})
    whole = h.groupBy(*by).agg(F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    c = c.join(whole, list(by)) if by else c.crossJoin(F.broadcast(whole))  # one row
    c = c.withColumns({"fn": F.col("np") - F.col("tp"), "tn": F.col("nn") - F.col("fp")})
    c = c.withColumn("macro_f1", (f1(F.col("tp"), F.col("fp"), F.col("fn")) + f1(F.col("tn"), F.col("fn"), F.col("fp"))) / 2)
    best = c.groupBy(*by).agg(F.max(F.struct("macro_f1", (-F.col("p")).alias("low"))).alias("best"))
    return best.filter("best is not null").select(*by, (-F.col("best.low")).alias("threshold"), F.col("best.macro_f1").alias("macro_f1"))


def draws(groups: DataFrame, n_draws: int, seed: str, by: list[str] = ()) -> DataFrame:
    """(draw, k, group_id): for each draw as many groups as there are, with replacement, by MD5 of (seed, draw, k).

    The table has draws x groups rows, made by ``SPREAD`` tasks, and is joined to groups by rank, never crossed with clips.
    """
    ranked = ranking.ranked(groups.select(*by, "group_id").distinct(), "group_id", "r", by).withColumn("r", F.col("r") - 1)
    sizes = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    table = sizes.select(*by, "n", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw")).repartition(SPREAD, "draw").select(*by, "n", "draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "draw", "k")), 1, 12), 16, 10).cast("long")
    return table.withColumn("r", number % F.col("n")).join(ranked, [*by, "r"]).select(*by, "draw", "k", "group_id")


def bootstrap_auc(groups: DataFrame, drawn: DataFrame) -> DataFrame:
    """AUC of each draw over group rows (group_id, y, p); draws of one class give null."""
    return roc_auc(drawn.join(groups, "group_id"), ["draw"])


def interval(values: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """95 % percentile interval over the draws that are defined."""
    return values.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.expr(f"percentile({value}, 0.025)").alias("low"), F.expr(f"percentile({value}, 0.975)").alias("high"), F.count(F.lit(1)).alias("draws")
    )


def verdict(low: Column, high: Column) -> Column:
    return F.when(low > 0, "A better").when(high < 0, "B better").otherwise("inconclusive")
