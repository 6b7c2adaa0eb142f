"""Gate, invariants, evaluations and timelines on small cases worked out by hand."""

import hashlib
import json

import numpy as np
from pyspark.sql import functions as F

from echoline.functions import intake
from echoline.operators import evaluation, invariants, metrics, timeline


def test_raw_sound_has_an_exact_scale_and_a_least_length(spark):
    whole = np.arange(intake.RAW_SAMPLES, dtype="<i4") * 4096
    rows = spark.createDataFrame([(0, bytearray(whole.tobytes())), (1, bytearray(b"1234")), (2, None)], "id int, content binary")
    got = {r["id"]: r["x"] for r in rows.select("id", intake.raw_pcm32("content").alias("x")).collect()}
    assert got[1] is None and got[2] is None and got[0] == (whole / 2.0**31).tolist()


def test_drops_are_whole_or_refused(spark):
    files = {"metrics.json": b"{}", "comparison.json": b"[1]"}
    receipt = {f"{n[:-5]}_sha256": hashlib.sha256(c).hexdigest() for n, c in files.items()}

    def problems(given):
        rows = spark.createDataFrame([(n, bytearray(c)) for n, c in given.items()], "name string, content binary")
        return sorted(r["problem"] for r in invariants.drop_problems(rows).collect())

    sound = files | {"receipt.json": json.dumps(receipt).encode()}
    assert problems({}) == [] and problems(sound) == []
    assert problems(sound | {"metrics.json": b"SYNTHETIC"}) == ["metrics.json contains a synthetic fixture marker", "metrics.json sha256 does not match receipt"]
    assert problems(files)[0].startswith("expected exactly") and problems(sound | {"receipt.json": b"{"}) == ["receipt.json is not valid JSON"]


def test_outcome_of_verdicts(spark):
    good, bad = "compatible with improvement", "compatible with degradation"
    rows = spark.createDataFrame([(0, [good, good]), (1, [good, bad]), (2, [good, "inconclusive"]), (3, [])], "id int, v array<string>")
    got = [r["o"] for r in rows.orderBy("id").select(intake.outcome(F.col("v")).alias("o")).collect()]
    assert got == ["improvement", "degradation", "inconclusive", "inconclusive"]


def test_rounding_is_half_even(spark):
    assert spark.range(1).select(intake.six_decimals(F.lit(0.0000005)).alias("a"), intake.six_decimals(F.lit(0.0000015)).alias("b")).first()[:] == (0.0, 0.000002)


def test_one_receipt_per_checkpoint(spark):
    rows = spark.createDataFrame([("a", "k", "1"), ("b", "k", "1"), ("c", "m", "1"), ("d", "m", "2"), ("e", "n", None)], "run string, checkpoint string, receipt_sha256 string")
    assert evaluation.one_receipt(rows).first()["failures"] == 2


def test_level_trace_loops_and_starts_with_the_first(spark):
    measured = spark.createDataFrame([("s", 1.0, 10.0), ("s", 2.0, 20.0)], "session string, time double, level double")
    clocks = spark.createDataFrame([("s", 2.5, 3.0)], "session string, clock double, duration double")
    got = timeline.level_trace(clocks, measured, "session", "level", steps=4, step=1.0).first()["trace"]
    assert got == [20.0, 10.0, 10.0, 20.0]


def test_patterns_of_scenarios(spark):
    rows = evaluation.scenarios(spark.range(300).select(F.concat(F.lit("n"), "id").alias("name"))).collect()
    assert {r["pattern"] for r in rows} == {"quiet", "brief", "persistent", "intermittent", "ended"}
    for r in rows:
        flags = r["flags"]
        run = next((i for i, f in enumerate(reversed(flags)) if not f), len(flags))
        assert 31 <= len(flags) == r["n"] <= 64
        want = {"quiet": not any(flags), "brief": 1 <= run <= 12, "persistent": run >= 31, "intermittent": all(flags[2:7]) and 1 <= run <= 12, "ended": any(flags) and not any(flags[-5:])}
        assert want[r["pattern"]]


def test_incomplete_candidates_are_left_out(spark):
    rows = [("a", 0, 0.5), ("a", 1, 0.7), ("b", 0, 0.9), ("c", 0, 0.6), ("c", 1, 0.6), ("d", 0, 0.9), ("d", 0, 0.9)]
    assert evaluation.best_of_complete(spark.createDataFrame(rows, "candidate string, cv_fold int, auc double"), 2).first()["candidate"] == "a"


def test_whole_evaluation_is_that_of_brute_force(spark):
    """Threshold of the validation groups, counts and AUC of both levels in both folds, intervals over the same draws."""
    rng = np.random.default_rng(5)
    rows = [(i, int(g % 2), round(float(rng.normal(0.4 + 0.2 * (g % 2), 0.2)), 3), f"g{g}", ("validation", "test", "train")[g % 3]) for i, g in enumerate(rng.integers(0, 24, 160).tolist())]
    df = spark.createDataFrame(rows, "clip_id int, y int, p double, group_id string, fold string")
    got = {(r["fold"], r["level"]): r for r in evaluation.evaluate_run(df, draws=60, seed="s").collect()}

    def auc(scores):
        a, b = [p for y, p in scores if y], [p for y, p in scores if not y]
        return sum((u > v) + 0.5 * (u == v) for u in a for v in b) / (len(a) * len(b)) if a and b else None

    def counted(scores, t):
        return tuple(sum(y == c and (p >= t) == d for y, p in scores) for c, d in ((1, True), (0, True), (0, False), (1, False)))

    def macro(scores, t):
        tp, fp, tn, fn = counted(scores, t)
        f1 = lambda a, b, c: 2 * a / (2 * a + b + c) if 2 * a + b + c else 0.0
        return (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2

    clips = {f: {} for f in ("validation", "test")}
    for _, y, p, g, f in rows:
        if f in clips:
            clips[f].setdefault(g, []).append((y, p))
    groups = {f: {g: [(v[0][0], float(np.median([p for _, p in v])))] for g, v in c.items()} for f, c in clips.items()}
    flat = lambda d: [x for v in d.values() for x in v]
    val = flat(groups["validation"])
    ends = [p for _, p in val]
    t = min(ends + [min(ends) - 1e-9, max(ends) + 1e-9], key=lambda t: (-macro(val, t), t))
    drawn = {}
    for r in metrics.draws(df.filter("fold <> 'train'"), 60, "s", ["fold"]).collect():
        drawn.setdefault((r["fold"], r["draw"]), []).append(r["group_id"])
    assert set(got) == {(f, x) for f in clips for x in ("clip", "group")}
    for (f, level), r in got.items():
        of = (clips if level == "clip" else groups)[f]
        values = [v for (g, _), names in drawn.items() if g == f and (v := auc([x for n in names for x in of[n]])) is not None]
        assert abs(r["threshold"] - t) < 1e-12 and (r["tp"], r["fp"], r["tn"], r["fn"]) == counted(flat(of), t)
        assert abs(r["roc_auc"] - auc(flat(of))) < 1e-12 and r["draws"] == len(values)
        assert np.allclose([r["low"], r["high"]], np.percentile(values, [2.5, 97.5]))
