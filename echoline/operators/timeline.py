"""Values along a clock: the latest measured one, traces of levels, open incidents, histories that a gap empties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoline.functions.config import HISTORY
from echoline.operators.ranking import bucket_of, quantile_cuts

#: Steps and seconds per step of a level trace, samples of a chart.
TRACE_STEPS, TRACE_STEP, CHART_SAMPLES = 80, 0.1, 240


def latest_at(clocks: DataFrame, measured: DataFrame, key: str, value: str) -> DataFrame:
    """Add ``value`` of the latest row of ``measured`` (key, time) at or before each row's ``time``, else that of the first.

    Clocks and measured rows of a key are put in order together, so no pair is formed. Of rows measured at the same
    time the largest value counts. A key that has no measured row gives null.
    """
    names = clocks.columns
    a = clocks.withColumns({"__rank": F.lit(1), "__value": F.lit(None).cast(measured.schema[value].dataType)})
    b = measured.select(key, "time", F.lit(0).alias("__rank"), F.col(value).alias("__value"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("time", "__rank", "__value")
    latest = F.last("__value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("__value", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn(value, F.coalesce(latest, first)).filter("__rank = 1").select(*names, value)


def level_trace(clocks: DataFrame, measured: DataFrame, key: str, value: str, steps: int = TRACE_STEPS, step: float = TRACE_STEP) -> DataFrame:
    """For each (key, clock, duration) the array ``trace`` of the last ``steps`` looped readings, oldest first."""
    back = clocks.select(key, "clock", "duration", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"))
    looped = back.withColumn("time", F.pmod(F.col("clock") - (steps - 1 - F.col("i")) * F.lit(step), F.col("duration")))
    read = latest_at(looped, measured, key, value)
    return read.groupBy(key, "clock", "duration").agg(F.sort_array(F.collect_list(F.struct("i", value))).alias("t")).select(key, "clock", "duration", F.col(f"t.{value}").alias("trace"))


def latest_by_range(left: DataFrame, right: DataFrame, time: str, value: str, ranges: int = 256) -> DataFrame:
    """Add ``value`` of the row of ``right`` with the latest ``time`` at or before each left row's, the first one's before that.

    There is no key to part by: the times of both sides are cut at quantiles into ``ranges``, each ordered by itself, and the last value
    of the ranges before is carried into the next. Every distinct time is ordered once, whatever number of rows has it;
    of right rows at one time the largest value counts. A null time gets null.
    """
    t = F.col(time)
    kind = right.schema[value].dataType
    given = right.filter(t.isNotNull() & F.col(value).isNotNull()).select(time, F.col(value).alias("__v"), F.lit(False).alias("__asked"))
    asked = left.filter(t.isNotNull()).select(time, F.lit(None).cast(kind).alias("__v"), F.lit(True).alias("__asked"))
    times = given.unionByName(asked).groupBy(time).agg(F.max("__v").alias("__v"), F.max("__asked").alias("__asked"))
    cut = times.crossJoin(F.broadcast(quantile_cuts(times, time, ranges)))  # one row
    both = cut.withColumn("__b", bucket_of(t, F.col("cuts"), ranges)).drop("cuts")
    known = F.when(F.col("__v").isNotNull(), t)
    tops = both.groupBy("__b").agg(F.max_by("__v", known).alias("__top"), F.min_by("__v", known).alias("__low"))  # at most ``ranges`` rows
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = tops.select("__b", F.last("__top", ignorenulls=True).over(before).alias("__before"), F.first("__low", ignorenulls=True).over(every).alias("__first"))
    inside = Window.partitionBy("__b").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    read = both.join(F.broadcast(carried), "__b").withColumn(value, F.coalesce(F.last("__v", ignorenulls=True).over(inside), "__before", "__first"))
    return left.join(read.filter("__asked").select(time, value), time, "left")


def open_incident(samples: DataFrame, incidents: DataFrame, key: str) -> DataFrame:
    """Add the first incident (key, incident, k0, k1) that is open at each sample ``k``: k0 <= k, and k < k1 if it has an end.

    An incident is the first open one from its start, or from the end of the last of those that began before it if that
    is later. These stretches don't overlap, so samples and stretches are put in order together and no pair is formed.
    Samples without an open incident, and those with a null key, get null.
    """
    earlier = Window.partitionBy(key).orderBy("k0", "incident").rowsBetween(Window.unboundedPreceding, -1)
    known = incidents.filter(F.col(key).isNotNull() & F.col("k0").isNotNull()).select(key, "incident", "k0", "k1")
    ends = known.withColumns({"__endless": F.coalesce(F.max(F.col("k1").isNull()).over(earlier), F.lit(False)), "__from": F.greatest("k0", F.max("k1").over(earlier))})
    first = ends.filter(~F.col("__endless") & (F.col("k1").isNull() | (F.col("__from") < F.col("k1"))))
    stretch = first.select(key, F.col("__from").alias("k"), F.lit(0).alias("__rank"), F.struct("incident", "k1").alias("__s"))
    both = samples.withColumn("__rank", F.lit(1)).unionByName(stretch, allowMissingColumns=True)
    latest = F.last("__s", ignorenulls=True).over(Window.partitionBy(key).orderBy("k", "__rank").rowsBetween(Window.unboundedPreceding, 0))
    read = both.withColumn("__s", latest).filter("__rank = 1")
    inside = F.col("k").isNotNull() & (F.col("__s.k1").isNull() | (F.col("k") < F.col("__s.k1")))
    return read.select(*samples.columns, F.when(inside, F.col("__s.incident")).alias("incident"))


def on_clock(incidents: DataFrame, sample: Column) -> DataFrame:
    """Incidents with the samples k0, k1 and confirmed_k of their start, end and confirmation; ``sample`` maps the column ``at``."""
    for name, source in (("k0", "started_at"), ("k1", "resolved_at"), ("confirmed_k", "confirmed_at")):
        incidents = incidents.withColumn("at", F.col(source)).withColumn(name, sample)
    return incidents.drop("at")


def kept_history(rows: DataFrame, value: str, keep: int = HISTORY) -> DataFrame:
    """Add ``history``: up to ``keep`` values of a session up to each window; a lost window or an abstention empties it.

    Rows are (session, seq, value); an abstention has no value and an empty history.
    """
    w = Window.partitionBy("session").orderBy("seq")
    broken = (F.col("seq") - F.lag("seq").over(w) > 1) | F.col(value).isNull()
    runs = rows.withColumn("__run", F.sum(F.coalesce(broken.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("session", "__run").orderBy("seq").rowsBetween(1 - keep, 0)
    return runs.withColumn("history", F.collect_list(value).over(inside)).drop("__run")


def chart(readings: DataFrame, key: str, keep: int = CHART_SAMPLES, every: int = 40) -> DataFrame:
    """The last ``keep`` samples ``k`` of each key up to its newest, with ``tick`` where the clock shows a mark."""
    newest = readings.groupBy(key).agg(F.max("k").alias("__top"))
    return readings.join(newest, key).filter(F.col("k") > F.col("__top") - keep).withColumn("tick", F.pmod(F.col("k"), F.lit(every)) == 0).drop("__top")


def latest_reading(readings: DataFrame, key: str, value: str) -> DataFrame:
    """(key, k, value) of each key's newest sample; the largest value on a tie."""
    return readings.groupBy(key).agg(F.max(F.struct("k", value)).alias("m")).select(key, "m.*")


def newest(rows: DataFrame, order: str, keep: int, by: list[str] = ()) -> DataFrame:
    """The ``keep`` rows of the largest ``order``, of each key if ``by`` names one."""
    if not by:
        return rows.orderBy(F.desc(order)).limit(keep)
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).filter(F.col("__k") <= keep).drop("__k")


def first_pending(jobs: DataFrame, pending: Column, *order: str) -> DataFrame:
    """The pending job that has waited longest."""
    return jobs.filter(pending).orderBy(*order).limit(1)
