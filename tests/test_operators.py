import pytest
from pyspark.sql import functions as F

from echoline.functions import signals as S
from echoline.operators import audit, metrics, tracking


def windows(spark, ps, session="s", seqs=None):
    return spark.createDataFrame([(session, i, p) for i, p in zip(seqs or range(len(ps)), ps)], "session string, seq long, p double")


def kinds(spark, ps, **how):
    changes = tracking.transitions(tracking.track(windows(spark, ps, seqs=how.pop("seqs", None)), **how))
    return [(r["kind"], r["seq"], r["observed"], r["high"]) for r in changes.orderBy("seq", "kind").collect()]


def test_opens_on_third_high_and_ends_on_fifth_low(spark):
    assert kinds(spark, [0.1] * 3 + [0.9] * 4 + [0.1] * 5) == [("opened", 5, 3, 3), ("ended", 11, 9, 4)]


def test_persists_on_the_31st_high_and_ends_with_its_counters(spark):
    got = kinds(spark, [0.1] * 3 + [0.9] * 35 + [0.1] * 5)
    assert got == [("opened", 5, 3, 3), ("persistent", 33, 31, 31), ("ended", 42, 40, 35)]


def test_gap_restarts_the_count(spark):
    assert [k[0] for k in kinds(spark, [0.9] * 34, seqs=[*range(20), *range(21, 35)])] == ["opened"]
    assert kinds(spark, [0.9, 0.9, None, 0.9, 0.9]) == []


@pytest.mark.parametrize(
    ("history", "pattern"),
    [([0.9] * 30, "brief"), ([0.9] * 31, "persistent"), ([0.9] * 10 + [0.1] * 5, "ended"), ([0.9] * 5 + [0.1] * 5 + [0.9] * 5, "intermittent"),
     ([0.1] * 33 + [0.9] * 31, "persistent"), ([0.9] * 31 + [0.1] * 33, "ended"), ([0.5], "quiet")],
)
def test_patterns(spark, history, pattern):
    df = spark.createDataFrame([(history,)], "h array<double>").select(tracking.facts(F.col("h")).alias("f"))
    assert df.first()["f"]["pattern"] == pattern


def scores(spark, y, p, g=None):
    return spark.createDataFrame(list(zip(y, p, g or y)), "y int, p double, group_id string" if g else "y int, p double, group_id int")


@pytest.mark.parametrize(("y", "p", "ap"), [([1, 0], [0.5, 0.5], 0.5), ([0, 1], [0.5, 0.5], 0.5), ([1, 0, 1, 0], [0.9, 0.5, 0.5, 0.1], 5 / 6), ([1, 1], [0.8, 0.2], None), ([0, 0], [0.8, 0.2], None)])
def test_average_precision(spark, y, p, ap):
    got = metrics.average_precision(scores(spark, y, p)).first()["pr_auc"]
    assert got == (None if ap is None else pytest.approx(ap))


def test_auc_counts_ties_half_and_is_null_for_one_class(spark):
    assert metrics.roc_auc(scores(spark, [1, 0, 1, 0], [0.9, 0.5, 0.5, 0.1])).first()[0] == pytest.approx(0.875)
    assert metrics.roc_auc(scores(spark, [1, 1], [0.9, 0.5])).first()[0] is None


def test_threshold_golden_values(spark):
    assert metrics.pick_threshold(metrics.group_medians(scores(spark, [0, 0, 1, 1], [0.1, 0.3, 0.7, 0.9], ["a", "a", "b", "b"]))).first()["threshold"] == pytest.approx(0.8)
    assert metrics.pick_threshold(scores(spark, [0, 1], [0.5, 0.5])).first()["threshold"] == 0.5 - 1e-9


def test_decision_counts(spark):
    y, p = [1] * 3 + [0] + [0] * 4 + [1] * 2, [0.9] * 4 + [0.1] * 6
    r = metrics.metric_block(scores(spark, y, p), 0.5).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (3, 1, 4, 2)
    assert (r["precision"], r["recall"], r["fpr"]) == pytest.approx((0.75, 0.6, 0.2))


@pytest.mark.parametrize(("low", "high", "text"), [(0.1, 0.3, "A better"), (-0.3, -0.1, "B better"), (-0.1, 0.3, "inconclusive")])
def test_verdicts(spark, low, high, text):
    assert spark.range(1).select(metrics.verdict(F.lit(low), F.lit(high))).first()[0] == text


def test_contract_negative_cases(spark):
    split = spark.createDataFrame([("a",), ("b",), ("c",)], "clip_id string")
    bad = spark.createDataFrame([("a", 0.5), ("a", 0.6), ("x", 1.5), ("b", float("nan"))], "clip_id string, p double")
    checks = {r["name"]: (r["coverage"], r["failures"]) for r in audit.prediction_contract(bad, split).collect()}
    assert checks == {"no_duplicate_id": (3, 1), "no_unknown_id": (4, 1), "no_missing_id": (3, 1), "finite_probability": (4, 2)}
    with pytest.raises(ValueError, match="no_duplicate_id"):
        audit.enforce(audit.prediction_contract(bad, split))
    with pytest.raises(ValueError, match="fold"):
        audit.forbid(spark.createDataFrame([(1, "t")], "clip_id int, fold string"))


def test_quality_problems(spark):
    cases = [([0.0] * 8, "silent"), ([1.0] * 8, "silent"), ([float("nan")] + [0.1] * 7, "not_finite"), ([0.1] * 7, "length"), ([-1.5] + [0.1] * 7, "out_of_range"), ([0.1, -0.1] * 4, None)]
    df = spark.createDataFrame([(x,) for x, _ in cases], "x array<double>")
    assert [r[0] for r in df.select(S.quality_problem(F.col("x"), 8)).collect()] == [c for _, c in cases]


def test_rms_normalised_and_correlation(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 6.0], [-1.6 * v - 0.17 for v in (1.0, 2.0, 3.0, 6.0)], [5.0] * 4)], "a array<double>, b array<double>, c array<double>")
    r = df.select(S.rms_normalised(F.col("a")).alias("n"), S.pearson(F.col("a"), F.col("b")).alias("r"), S.pearson(F.col("a"), F.col("c")).alias("z"), S.rms_normalised(F.col("c")).alias("c")).first()
    assert sum(r["n"]) == pytest.approx(0) and sum(v * v for v in r["n"]) / 4 == pytest.approx(1)
    assert r["r"] == pytest.approx(-1) and r["z"] is None and r["c"] == [0.0] * 4


def test_reports_pairs_and_capacity(spark):
    made = lambda rows: spark.createDataFrame(rows, "k string, v double")
    r = audit.same_values(made([("a", 1.0), ("b", None), ("c", 1.0), ("d", 2.0)]), made([("a", 1.0), ("b", None), ("c", None), ("e", 2.0)]), "k", "v").first()
    assert (r["coverage"], r["failures"]) == (5, 3)
    q, rec = spark.createDataFrame([("q",), ("p",)], "query string"), spark.createDataFrame([("r",), ("s",)], "record string")
    log = lambda *pairs: spark.createDataFrame(pairs, "query string, record string")
    assert audit.exhaustive_pairs(log(("q", "r"), ("q", "s"), ("p", "r"), ("p", "s")), q, rec).first()["passed"]
    assert audit.exhaustive_pairs(log(("q", "r"), ("q", "r"), ("p", "r"), ("p", "x")), q, rec).first()["failures"] == 2
    assert audit.exhaustive_pairs(log(("q", "r"), ("q", "s")), q, rec).first()["failures"] == 1
    got = {r["name"]: (r["passed"], r["failures"]) for r in audit.within_capacity(made([("a", 1.0), ("a", 2.0), ("b", 1.0)]), "k", 1, 1).collect()}
    assert got == {"rows_per_key": (False, 1), "keys": (False, 1)}


def test_ranks_over_buckets_equal_a_sort(spark):
    import hashlib

    from echoline.operators import ranking

    keys = [f"k{i}" for i in range(500)]
    df = spark.createDataFrame([(k, i % 3) for i, k in enumerate(keys)], "key string, y int")
    got = {r["key"]: r["k"] for r in ranking.ranked(df, "key", "k", seed="s:").collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys, key=lambda k: hashlib.md5(f"s:{k}".encode()).hexdigest()))}
    assert ranking.ranked(df, "key", "k", ["y"]).groupBy("y").agg(F.max("k")).orderBy("y").collect() == [(0, 167), (1, 167), (2, 166)]
