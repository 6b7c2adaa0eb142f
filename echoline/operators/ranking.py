"""Ranks over all rows in an order that a seed decides, without a task that sees all of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values in which ranks are counted apart.
RANGES = 256


def quantile_cuts(rows: DataFrame, value: str, ranges: int) -> DataFrame:
    """One row (cuts): at most ``ranges`` - 1 sorted values that part the rows into ranges of about equal numbers."""
    places = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    return rows.agg(F.array_sort(F.array_distinct(F.coalesce(F.percentile_approx(F.col(value).cast("double"), places, 4 * ranges), F.array().cast("array<double>")))).alias("cuts"))


def bucket_of(value: Column, cuts: Column, ranges: int) -> Column:
    """How many of the sorted ``cuts``, fewer than ``ranges``, lie at or below the value; found by halving, not by a scan."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(ranges.bit_length()))])
    below = lambda at: F.get(cuts, at - 1) <= value.cast("double")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(cuts)) & below(at + step), at + step).otherwise(at))


def joined(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal columns ``by``, in which nulls are equal too."""
    named = right.withColumnsRenamed({c: f"__r_{c}" for c in by})
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in by], F.lit(True))
    return left.join(named, on, how).drop(*[f"__r_{c}" for c in by])


def between(low: Column, high: Column, share: Column) -> Column:
    """The value at ``share`` of the way between two, the lower one's part added without a rounding of its own, as DuckDB's quantile_cont does."""
    fused = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - share, high * share).cast("double")
    return F.when(share == 0, low).otherwise(fused)


def quantiles(rows: DataFrame, by: Sequence[str], value: str, places: dict[str, float]) -> DataFrame:
    """(by, names of ``places``): exact quantiles with linear interpolation of the values that aren't null; a key without any has no row.

    Rows become counts of distinct values, whose ranks start after the counts of the ranges before theirs. Only the ranges that hold a
    wanted rank are put in order, so no task sees all values of a key.
    """
    by = list(by)
    given = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v")).groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n"))
    cut = given.crossJoin(F.broadcast(quantile_cuts(given, "__v", RANGES)))  # one row
    counts = cut.withColumn("__range", bucket_of(F.col("__v"), F.col("cuts"), RANGES)).drop("cuts")
    key = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = key.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    totals = counts.groupBy(*by, "__range").agg(F.sum("__n").alias("__m")).withColumns({"__end": F.sum("__m").over(upto), "__all": F.sum("__m").over(key)})
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), ((F.col("__all") - 1) * F.lit(q)).alias("at")) for k, q in places.items()]))
    spots = totals.withColumn("__s", at).withColumn("__start", F.col("__end") - F.col("__m"))
    # Ranks are counted from 0; the two next to a place may lie in two ranges.
    spots = spots.withColumn("__rank", F.explode(F.array_distinct(F.array(F.floor("__s.at"), F.ceil("__s.at"))))).filter((F.col("__rank") >= F.col("__start")) & (F.col("__rank") < F.col("__end")))
    held = spots.groupBy(*by, "__range", "__start").agg(F.collect_list(F.struct(F.col("__s.name").alias("name"), F.col("__s.at").alias("at"), F.col("__rank").alias("rank"))).alias("__wanted"))
    met = joined(counts, held, [*by, "__range"])
    inside = Window.partitionBy(*by, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ended = met.withColumn("__end", F.sum("__n").over(inside) + F.col("__start")).withColumn("__w", F.explode("__wanted"))
    found = ended.filter((F.col("__w.rank") < F.col("__end")) & (F.col("__w.rank") >= F.col("__end") - F.col("__n")))
    told = lambda k: between(F.min(F.when(F.col("__w.name") == k, F.col("__v"))), F.max(F.when(F.col("__w.name") == k, F.col("__v"))), F.max(F.when(F.col("__w.name") == k, F.col("__w.at") - F.floor("__w.at"))))
    return found.groupBy(*by).agg(*[told(k).alias(k) for k in places])


def ranked(rows: DataFrame, key: str, name: str, by: Sequence[str] = (), seed: str = "") -> DataFrame:
    """Add ``name``: ranks from 1 in the order of (MD5 of seed and key, key), per ``by``; keys and ``by`` are not null.

    The hash's first three digits make 4096 buckets of about equal size: ranks run inside a bucket and start after
    the rows of those before it, of which only the counts are summed in one place.
    """
    by = list(by)
    text = F.concat(F.lit(seed), F.col(key).cast("string"))
    hashed = rows.withColumn("__hash", F.md5(text)).withColumn("__bucket", F.substring("__hash", 1, 3))
    earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashed.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select(*by, "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy("__hash", key))
    out = hashed.withColumn("__k", inside).join(starts, [*by, "__bucket"])
    return out.withColumn(name, F.col("__k") + F.col("__start")).select(*rows.columns, name)


def grouped_folds(rows: DataFrame, folds: int, seed: str) -> DataFrame:
    """(group_id, y, cv_fold): groups of a class dealt to folds in turn, in shuffled order."""
    groups = ranked(rows.select("group_id", "y").distinct(), "group_id", "k", ["y"], f"{seed}:")
    return groups.select("group_id", "y", ((F.col("k") - 1) % folds).alias("cv_fold"))


def shuffled_labels(rows: DataFrame, seed: str) -> DataFrame:
    """(group_id, shuffled): the groups' classes dealt anew, as a negative control."""
    groups = rows.select("group_id", "y").distinct()
    there = ranked(groups, "group_id", "k").select("k", "group_id")
    return there.join(ranked(groups, "group_id", "k", seed=f"{seed}:").select("k", F.col("y").alias("shuffled")), "k").select("group_id", "shuffled")
