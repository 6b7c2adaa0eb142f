"""Whole evaluations of runs: aligned scores, thresholds from validation only, two levels with intervals, audits, tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoline.functions.config import DRAWS
from echoline.functions.intake import probability, six_decimals
from echoline.operators import metrics, ranking, resampling
from echoline.operators.audit import check

#: Order of the controls in reports, batch sizes of a parity run, tolerance of scores.
CONTROLS = ("c0", "c1", "c2", "c2b", "c3")
BATCH_SIZES = (1, 2, 4)
SCORE_TOLERANCE = 1e-6
#: Fixed values of drawn scenarios: patterns, windows, the end's first window and its distance from the last, long and short high ends, a lead, an early stretch.
PATTERNS = ("quiet", "brief", "persistent", "intermittent", "ended")
SCENARIO_WINDOWS, STOP, LONG_TAIL, SHORT_TAIL, LEAD, EARLY = (31, 65), (10, 4), 31, (1, 13), (3, 10), (2, 6)
#: Fixed value: what stands for a rate whose denominator is zero.
NO_RATE = "—"


def aligned(split: DataFrame, run: DataFrame, fold: str | None = None) -> DataFrame:
    """Clips of a split (clip_id, y, group_id, fold) with the run's p, inner by clip_id; ``fold`` keeps one of them."""
    rows = split if fold is None else split.filter(F.col("fold") == fold)
    return rows.join(run.select("clip_id", "p"), "clip_id")


def decided(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.withColumn("decision", (F.col("p") >= threshold).cast("int"))


def levels(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rows of both levels: each clip as ``clip`` and the median of each group as ``group``."""
    clips = rows.select(*by, F.lit("clip").alias("level"), F.col("y").cast("int").alias("y"), "p")
    return clips.unionByName(metrics.group_medians(rows, list(by)).select(*by, F.lit("group").alias("level"), F.col("y").cast("int").alias("y"), "p"))


def evaluate_run(rows: DataFrame, validation: str = "validation", folds: tuple[str, ...] = ("validation", "test"), draws: int = DRAWS, seed: str = "evaluation") -> DataFrame:
    """One row per fold and level of a run (clip_id, y, p, group_id, fold): counts, rates and AUC with its 95 % interval.

    The threshold is picked on the groups of the validation fold alone and used for both folds. It travels as a
    one-row table. Intervals come from ``draws`` resamplings of whole groups within each fold.
    """
    by = ["fold", "level"]
    rows = rows.filter(F.col("fold").isin(*folds))
    picked = metrics.pick_threshold(metrics.group_medians(rows.filter(F.col("fold") == validation))).select("threshold")
    both = levels(rows, ["fold"])
    # Scores become their distance from the threshold, so that one block of counts at 0 serves a threshold that is not known here.
    counts = metrics.metric_block(both.crossJoin(F.broadcast(picked)).withColumn("p", F.when(F.col("p") >= F.col("threshold"), 1.0).otherwise(0.0)), 0.5, by)
    # A draw takes a group some number of times, and equal scores of a group are one row with their number: draws meet cells, not clips.
    drawn = metrics.draws(rows, draws, seed, ["fold"]).groupBy("fold", "draw", "group_id").agg(F.count(F.lit(1)).alias("times"))
    cells = rows.groupBy("fold", "group_id", "y", "p").agg(F.count(F.lit(1)).alias("n")).withColumn("level", F.lit("clip"))
    medians = metrics.group_medians(rows, ["fold"]).select("fold", "group_id", "y", "p", F.lit(1).cast("long").alias("n"), F.lit("group").alias("level"))
    resampled = drawn.join(cells.unionByName(medians), ["fold", "group_id"]).select("fold", "draw", "level", "y", "p", (F.col("times") * F.col("n")).alias("n"))
    intervals = metrics.interval(metrics.roc_auc(resampled, ["fold", "level", "draw"], "n"), "roc_auc", by)
    joined = counts.join(metrics.roc_auc(both, by), by).join(intervals, by, "left")
    return joined.crossJoin(F.broadcast(picked))  # one row


def threshold_checks(declared: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Checks of declared thresholds (run, threshold, reported) against recomputed ones (run, threshold), bit by bit.

    ``reported`` is the six-decimal form of a report; a declared threshold that is only that form is refused.
    """
    both = declared.join(recomputed.select("run", F.col("threshold").alias("__full")), "run", "full_outer")
    exact = F.coalesce(F.col("threshold") == F.col("__full"), F.lit(False))
    shown = F.coalesce(F.col("reported") == six_decimals(F.col("__full")), F.lit(False))
    return check(both, "exact_threshold", ~exact).unionByName(check(both, "reported_threshold", ~shown))


def one_receipt(proofs: DataFrame) -> DataFrame:
    """Check over (run, checkpoint, receipt_sha256) that every checkpoint keeps one receipt for all its runs."""
    per = proofs.groupBy("checkpoint").agg(F.countDistinct("receipt_sha256").alias("n"), F.count("receipt_sha256").alias("given"), F.count(F.lit(1)).alias("runs"))
    return check(per, "one_receipt", (F.col("n") != 1) | (F.col("given") != F.col("runs")))


def latency_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, median, 95th percentile (linear), least and largest of a duration; all but n are null if there is none."""
    told = rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"))
    placed = ranking.quantiles(rows, by, value, {"median_ms": 0.5, "p95_ms": 0.95})
    return ranking.joined(told, placed, by, "left").select(*by, "n", "median_ms", "p95_ms", "min_ms", "max_ms")


def text_audit(rows: DataFrame) -> DataFrame:
    """Per fold the counts of (fold, clip_id, error, abstained, format_valid, correct_band, disagrees); errors stay in every denominator."""
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    n = F.count(F.lit(1))
    c = rows.groupBy("fold").agg(
        n.alias("n_attempted"), F.countDistinct("clip_id").alias("n_clips"), F.count("error").alias("n_errors"), yes("abstained").alias("n_abstentions"), yes("format_valid").alias("n_valid_format"),
        yes("correct_band").alias("n_correct_band"), F.count("disagrees").alias("n_comparable"), yes("disagrees").alias("n_disagreements"),
    )
    total = F.col("n_attempted")
    return c.withColumns({
        "valid_format_rate": metrics.ratio(F.col("n_valid_format"), total), "correct_band_rate": metrics.ratio(F.col("n_correct_band"), total),
        "n_wrong_band": F.col("n_valid_format") - F.col("n_correct_band"), "n_no_usable_text": total - F.col("n_valid_format"),
        "disagreement_rate": metrics.ratio(F.col("n_disagreements"), F.col("n_comparable")), "n_not_comparable": total - F.col("n_comparable"),
    })


def whole_text_audit(rows: DataFrame, expected: dict[str, int], latencies: tuple[str, ...] = ("api_ms", "generation_ms")) -> DataFrame:
    """``text_audit`` of folds whose clips are all there, with expected counts, errors by class and latencies as columns.

    Rows also have the durations named by ``latencies``, null where nothing was called, and ``paid`` for calls that gave an answer.
    A fold with a clip too few, too many or twice, and a fold that isn't expected, are refused by name.
    """
    want = rows.sparkSession.createDataFrame(sorted(expected.items()), "fold string, n_expected long")
    per = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("clip_id").alias("d"))
    both = want.join(per, "fold", "full_outer")
    wrong = both.filter(~F.coalesce((F.col("n") == F.col("n_expected")) & (F.col("d") == F.col("n")), F.lit(False))).orderBy("fold").collect()
    if wrong:
        raise ValueError("clips missing or repeated in " + ", ".join(r["fold"] for r in wrong))
    classes = rows.filter("error is not null").groupBy("fold", "error").agg(F.count(F.lit(1)).alias("n")).groupBy("fold")
    errors = classes.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("error", "n")))).alias("error_counts"))
    out = want.join(text_audit(rows), "fold").join(errors, "fold", "left").withColumn("error_counts", F.coalesce("error_counts", F.create_map().cast("map<string,bigint>")))
    for name in latencies:
        for kind, part in (("all", rows), ("paid", rows.filter("paid"))):
            own = latency_summary(part, ["fold"], name)
            out = out.join(own.select("fold", F.struct(*own.columns[1:]).alias(f"{name}_{kind}")), "fold", "left")
    return out


def percent(a: Column, b: Column) -> Column:
    """``12.3 %`` of a ratio, or a dash for a zero denominator."""
    return F.when(b == 0, NO_RATE).otherwise(F.format_string("%.1f %%", 100 * metrics.ratio(a, b)))


def decision_table(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Texts of the rates of counts (tp, fp, tn, fn), read off without any new decision."""
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return blocks.select(
        *by, (tp + fn).alias("leaks"), (tn + fp).alias("quiet"), fp.alias("fp"), fn.alias("fn"), percent(tp, tp + fp).alias("precision"), percent(2 * tp, 2 * tp + fp + fn).alias("f1"),
        percent(tp, tp + fn).alias("recall"), percent(fp, fp + tn).alias("fpr"), percent(fn, tp + fn).alias("missed"),
    )


def in_report_order(runs: DataFrame, run: str = "run") -> DataFrame:
    """Controls first in their order, then all other runs by name."""
    at = F.array_position(F.array(*map(F.lit, CONTROLS)), F.col(run))
    return runs.orderBy(F.when(at > 0, at).otherwise(100), run)


def signed(v: Column) -> Column:
    """A difference with its sign and three decimals."""
    return F.format_string("%+.3f", v)


def run_pairs(runs: DataFrame, run: str = "run") -> DataFrame:
    """All pairs a < b of the runs of one evaluation: a handful of names, taken from one sorted array."""
    names = runs.agg(F.sort_array(F.collect_set(run)).alias("names"))
    first = names.select("names", F.posexplode("names").alias("i", "a"))
    return first.select("a", F.explode(F.filter("names", lambda b, j: j > F.col("i"))).alias("b"))


def by_verdict(verdicts: DataFrame, name: str, verdict: str) -> DataFrame:
    """Per verdict its number of names and their list in words: ``x``, ``x and y`` or ``x, y and z``."""
    per = verdicts.groupBy(verdict).agg(F.sort_array(F.collect_list(name)).alias("names"))
    n = F.size("names")
    words = F.when(n == 1, F.get("names", F.lit(0))).otherwise(F.concat(F.array_join(F.slice("names", F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at("names", -1)))
    return per.select(verdict, n.alias("n"), words.alias("names"))


def array_difference(a: Column, b: Column) -> Column:
    """Struct (same_shape, exact, n_different, max_abs, mean_abs, at) of two arrays; the gaps are null for unequal shapes."""
    gaps = F.zip_with(a, b, lambda u, v: F.abs(u - v))
    top = F.array_max(gaps)
    same, empty = F.size(a) == F.size(b), F.size(a) == 0
    known = lambda v, none: F.when(same, F.when(empty, none).otherwise(v))
    return F.struct(
        same.alias("same_shape"), (same & F.forall(gaps, lambda g: g.isNotNull() & (g == 0))).alias("exact"), known(F.size(F.filter(gaps, lambda g: g != 0)), 0).alias("n_different"),
        known(top, 0.0).alias("max_abs"), known(F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g) / F.size(gaps), 0.0).alias("mean_abs"), known(F.array_position(gaps, top) - 1, None).alias("at"),
    )


def batched(rows: DataFrame, sizes: tuple[int, ...] = BATCH_SIZES) -> DataFrame:
    """(clip_id, route, batch, place): every clip's batch for each size, in the hashed order of the ids and in its reverse.

    Ranks run in hash buckets (``ranking.ranked``), so no task sees all rows.
    """
    ranked = ranking.ranked(rows, "clip_id", "__k").withColumn("__k", F.col("__k") - 1)
    n = rows.agg(F.count(F.lit(1)).alias("__n"))
    both = ranked.crossJoin(F.broadcast(n)).select("*", F.explode(F.array(F.struct(F.lit("forward").alias("order"), F.col("__k").alias("k")), F.struct(F.lit("reversed").alias("order"), (F.col("__n") - 1 - F.col("__k")).alias("k")))).alias("o"))
    sized = both.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    return sized.select(*rows.columns, F.concat_ws("_", F.lit("batch"), "size", "o.order").alias("route"), F.floor(F.col("o.k") / F.col("size")).alias("batch"), F.pmod(F.col("o.k"), F.col("size")).alias("place"))


def batch_invariance(scores: DataFrame, routes: int, threshold: float | None = None) -> DataFrame:
    """Score spread over the routes of (clip_id, route, p), with clips that lack a route or have a broken score."""
    per = scores.groupBy("clip_id").agg(F.countDistinct("route").alias("n"), F.count(F.lit(1)).alias("rows"), F.count_if(~probability(F.col("p"))).alias("broken"))
    faults = per.agg(F.count_if((F.col("n") != routes) | (F.col("rows") != routes) | (F.col("broken") > 0)).alias("faulty"))
    return resampling.score_spread(scores, 0.5 if threshold is None else threshold, SCORE_TOLERANCE).crossJoin(faults)  # one row each


def compare_routes(routes: DataFrame, reference: str) -> DataFrame:
    """Of (clip_id, route, x): each route against the reference route, clip by clip, as columns of ``array_difference``."""
    base = routes.filter(F.col("route") == reference).select("clip_id", F.col("x").alias("__x"))
    both = routes.filter(F.col("route") != reference).join(base, "clip_id")
    return both.select("clip_id", "route", array_difference(F.col("__x"), F.col("x")).alias("d")).select("clip_id", "route", "d.*")


def best_of_complete(fits: DataFrame, wanted: int, score: str = "auc") -> DataFrame:
    """The candidate of the best mean score among those with all ``wanted`` folds; the first name on a tie.

    A candidate (candidate, cv_fold, score) that lacks a fold, has one twice or a broken score is left out.
    """
    per = fits.groupBy("candidate").agg(F.countDistinct("cv_fold").alias("folds"), F.count(score).alias("n"), F.count(F.lit(1)).alias("rows"), F.avg(score).alias("mean"))
    whole = per.filter((F.col("folds") == wanted) & (F.col("n") == wanted) & (F.col("rows") == wanted) & ~F.isnan("mean"))
    return resampling.choose(whole.select("candidate", "mean"), "mean", "candidate")


def scenarios(names: DataFrame, key: str = "name") -> DataFrame:
    """Sequences of low and high windows with a known pattern, drawn by MD5 of the name.

    Adds ``pattern`` (quiet, brief, persistent, intermittent, ended), ``flags`` (31 to 64 windows, true where high): a
    short or long high end, a high stretch before a short end, or one that is over well before the last window.
    """
    draw = lambda i, lo, hi: lo + F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key), F.lit(i))), 1, 8), 16, 10).cast("long") % (hi - lo)
    rows = names.withColumn("n", draw(0, *map(F.lit, SCENARIO_WINDOWS))).withColumn("pattern", F.element_at(F.array(*map(F.lit, PATTERNS)), (draw(1, F.lit(0), F.lit(len(PATTERNS))) + 1).cast("int")))
    stop = draw(2, F.lit(STOP[0]), F.col("n") - STOP[1])
    tail = F.when(F.col("pattern") == "persistent", draw(3, F.lit(LONG_TAIL), F.col("n") + 1)).otherwise(draw(4, *map(F.lit, SHORT_TAIL)))
    lead = draw(5, *map(F.lit, LEAD))
    ends_high = F.col("pattern").isin("brief", "persistent", "intermittent")
    high = lambda i: (
        (ends_high & (i >= F.col("n") - F.col("tail"))) | ((F.col("pattern") == "intermittent") & i.between(*EARLY)) | ((F.col("pattern") == "ended") & (i >= F.greatest(F.lit(0), F.col("stop") - F.col("lead"))) & (i < F.col("stop")))
    )
    rows = rows.withColumns({"stop": stop, "tail": tail, "lead": lead})
    return rows.withColumn("flags", F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), high)).drop("stop", "tail", "lead")


def stretches(low: float, high: float, *parts: tuple[str, int]) -> Column:
    """Array of scores from stretches such as ("low", 3), ("high", 35), ("low", 5)."""
    return F.flatten(F.array(*[F.array_repeat(F.lit(low if kind == "low" else high), n) for kind, n in parts]))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, with the number of rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")

