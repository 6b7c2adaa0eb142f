"""Tracking of persistent activity per session, as windows over (session, seq): hysteresis is the last trigger.

Rows are (session, seq, p); a null p is an abstention. One shuffle by session serves every step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoline.functions import config


def _upto(*part: str):
    return Window.partitionBy(*part).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)


def gaps(rows: DataFrame) -> DataFrame:
    """Add ``missing`` windows before each row and ``brk``: a gap, a first row, or an abstention here or just before."""
    by = Window.partitionBy("session").orderBy("seq")
    last = F.lag("seq", 1, -1).over(by)
    return rows.withColumn("missing", F.col("seq") - last - 1).withColumn(
        "brk", F.row_number().over(by).eqNullSafe(1) | (F.col("missing") > 0) | F.col("p").isNull() | F.lag("p").over(by).isNull()
    )


def run_length(rows: DataFrame, name: str, on: Column) -> DataFrame:
    """Add ``name``: how many rows up to here are ``on`` without a break (gaps and islands)."""
    flagged = rows.withColumn("__on", F.coalesce(on, F.lit(False)))
    flagged = flagged.withColumn("__island", F.sum((F.col("brk") | ~F.col("__on")).cast("int")).over(_upto("session")))
    # A break starts an island that may itself be on; a row that is off starts one that counts from 0.
    return flagged.withColumn(name, F.sum(F.col("__on").cast("int")).over(_upto("session", "__island"))).drop("__on", "__island")


def track(rows: DataFrame, open_at=config.OPEN_AT, open_run=config.OPEN_RUN, close_at=config.CLOSE_AT, close_run=config.CLOSE_RUN, persist_over=config.PERSIST_OVER) -> DataFrame:
    """Every window with its runs, state, event number and the event's counters.

    The state is that of the last trigger: opened after ``open_run`` high windows in a row, closed after
    ``close_run`` low ones. Counters of an event also count the windows that led to its opening.
    """
    out = gaps(rows)
    out = run_length(out, "high_run", F.col("p") >= open_at)
    out = run_length(out, "low_run", F.col("p") <= close_at)
    trigger = F.when(F.col("high_run") >= open_run, 1).when(F.col("low_run") >= close_run, 0)
    out = out.withColumn("state", F.coalesce(F.last(trigger, ignorenulls=True).over(_upto("session")), F.lit(0)))
    out = out.withColumn("was", F.lag("state", 1, 0).over(Window.partitionBy("session").orderBy("seq")))
    out = out.withColumn("opened", (F.col("state") == 1) & (F.col("was") == 0)).withColumn("ended", (F.col("state") == 0) & (F.col("was") == 1))
    out = out.withColumn("event", F.sum(F.col("opened").cast("int")).over(_upto("session")))
    inside = (F.col("state") == 1) | (F.col("was") == 1)
    lead = open_run - 1
    by = _upto("session", "event")
    counted = lambda cond: F.when(inside, F.sum((inside & cond).cast("int")).over(by) + lead)
    out = out.withColumn("observed", counted(F.col("p").isNotNull())).withColumn("high", counted(F.coalesce(F.col("p") >= open_at, F.lit(False))))
    out = out.withColumn("interrupted", F.when(inside, F.max((inside & F.col("brk") & ~F.col("opened")).cast("int")).over(by) == 1))
    over = inside & (F.col("state") == 1) & (F.col("high_run") > persist_over)
    first = F.sum(over.cast("int")).over(by) == 1
    return out.withColumn("persistent", over & first)


def transitions(tracked: DataFrame) -> DataFrame:
    """(session, event, kind, seq, observed, high, interrupted): one row per opening, end and persistence alert."""
    kinds = F.filter(F.array(*[F.when(F.col(k), F.lit(k)) for k in ("opened", "persistent", "ended")]), lambda k: k.isNotNull())
    return tracked.filter("opened or ended or persistent").select("session", "event", F.explode(kinds).alias("kind"), "seq", "observed", "high", "interrupted")


def previews(changes: DataFrame) -> DataFrame:
    """Unsent message per (session, event, kind)."""
    text = F.when(F.col("kind") == "opened", F.format_string("Session %s: activity confirmed at window %d.", "session", "seq")).when(
        F.col("kind") == "persistent", F.format_string("Session %s: activity persists after %d high windows.", "session", "high")
    ).otherwise(F.format_string("Session %s: activity ended after %d windows.", "session", "observed"))
    return changes.select("session", "event", "kind", text.alias("message"), F.lit(False).alias("sent"))


def quiet_end(history: Column, low=config.CLOSE_AT, close_run=config.CLOSE_RUN) -> Column:
    """Whether the last ``close_run`` scores are all low."""
    enough = F.size(history) >= close_run
    # The slice must not start before the array.
    return enough & F.forall(F.slice(history, F.greatest(F.lit(1), F.size(history) - close_run + 1), F.lit(close_run)), lambda p: p <= low)


def facts(history: Column, high=config.OPEN_AT, low=config.CLOSE_AT, close_run=config.CLOSE_RUN, persist_over=config.PERSIST_OVER) -> Column:
    """Runs, current and longest high run, high total and pattern of an array of scores, as a struct."""
    zero = F.struct(*[F.lit(0).alias(c) for c in ("runs", "current", "longest", "total")])

    def step(acc: Column, p: Column) -> Column:
        on = p >= high
        current = F.when(on, acc["current"] + 1).otherwise(0)
        return F.struct(
            (acc["runs"] + (on & (acc["current"] == 0)).cast("int")).alias("runs"), current.alias("current"),
            F.greatest(acc["longest"], current).alias("longest"), (acc["total"] + on.cast("int")).alias("total"),
        )

    counted = F.aggregate(history, zero, step)
    quiet = quiet_end(history, low, close_run)

    def named(c: Column) -> Column:
        pattern = (
            F.when(c["current"] > persist_over, "persistent").when((c["total"] > 0) & quiet, "ended")
            .when(c["runs"] > 1, "intermittent").when(c["total"] > 0, "brief").otherwise("quiet")
        )
        return F.struct(*[c[x].alias(x) for x in ("runs", "current", "longest", "total")], pattern.alias("pattern"))

    return F.transform(F.array(counted), named)[0]


def anomaly_runs(rows: DataFrame, factor: float = 1.6, longest: int = 481) -> DataFrame:
    """Add to (session, seq, value, baseline) whether a reading is anomalous and the run of such readings up to it."""
    odd = rows.withColumn("brk", F.lit(False)).withColumn("anomalous", F.col("value") > factor * F.col("baseline"))
    runs = run_length(odd, "run", F.col("anomalous"))
    return runs.withColumn("run", F.least(F.col("run"), F.lit(longest))).drop("brk")


def sliding(rows: DataFrame, value: str, width: int) -> DataFrame:
    """Mean and population variance of the last ``width`` rows of a session, null until there are so many."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(1 - width, 0)
    full = F.count(F.lit(1)).over(w) == width
    return rows.withColumns({"mean": F.when(full, F.avg(value).over(w)), "variance": F.when(full, F.var_pop(value).over(w))})
