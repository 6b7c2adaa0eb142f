"""Functions of signals, audits and reports that no query needs as they are, against small plain versions."""

import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echoline.functions import features, intake, series
from echoline.operators import evaluation, invariants, ranking, timeline
from tests.oracle import expected, rows


def test_waveform_identities_name_their_format(spark):
    x = np.random.default_rng(0).normal(size=20)
    rows = [(x.tolist(), 8000), ([], 8000), (None, 8000), ([float("nan")], 8000), (x.tolist(), 16000)]
    got = [r[0] for r in spark.createDataFrame(rows, "x array<double>, r int").select(intake.waveform_identity("my-f64le")("x", "r")).collect()]
    plain = lambda v, r: hashlib.sha256(json.dumps({"format": "my-f64le", "sample_rate": r, "shape": [len(v)]}, sort_keys=True, separators=(",", ":")).encode() + b"\0" + np.asarray(v, "<f8").tobytes()).hexdigest()
    assert got == [plain(x, 8000), plain([], 8000), None, None, plain(x, 16000)]
    other = spark.createDataFrame(rows[:1], "x array<double>, r int").select(intake.waveform_identity("other")("x", "r")).first()[0]
    assert other != got[0]
    with pytest.raises(ValueError):
        intake.waveform_identity("")


def test_features_through_single_precision(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=8000) * 1000 + 17
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    z = (x - x.mean()) / np.sqrt(((x - x.mean()) ** 2).mean())
    want = features.amplitude(z.astype(np.float32).astype(float)[None])[0]
    got = df.select(features.features("amplitude", single=True)("x").alias("f")).first()["f"]
    plain = df.select(features.features("amplitude")("x").alias("f")).first()["f"]
    assert list(got) == want.tolist() and list(got) != list(plain) and list(got) == pytest.approx(list(plain), rel=1e-5, abs=1e-6)


def test_preprocessing_has_versions(spark):
    x = np.random.default_rng(2).normal(size=8000)
    versions = {"plain": False, "stored": True}
    rows = [(x.tolist(), 8000), (x.tolist(), 16000), (x[:-1].tolist(), 8000), (None, 8000), ([float("inf")] * 8000, 8000)]
    df = spark.createDataFrame(rows, "x array<double>, r int")
    z = (x - x.mean()) / np.sqrt(((x - x.mean()) ** 2).mean())
    for version, single in versions.items():
        got = [r["p"] for r in df.select(series.preprocessed(version, versions)("x", "r").alias("p")).collect()]
        want = series.band_energies(z.astype(np.float32).astype(float) if single else z)
        assert np.array_equal(np.array(got[0]["series"], np.float32), want) and np.shape(got[0]["series"]) == (4, 64)
        assert [g["problem"] for g in got] == [None, "sample_rate", "length", "missing", "not_finite"] and all(g["series"] is None for g in got[1:])
    with pytest.raises(ValueError, match="not one of"):
        series.preprocessed("next", versions)


AUDIT = "fold string, clip_id string, error string, abstained boolean, format_valid boolean, correct_band boolean, disagrees boolean, api_ms double, generation_ms double, paid boolean"


def test_a_whole_text_audit(spark):
    rows = [("val", f"v{i}", None, False, True, i % 2 == 0, i == 1, 10.0 * i, 5.0, True) for i in range(5)]
    rows += [("test", "t0", "Timeout", False, False, False, None, 900.0, None, False), ("test", "t1", "Timeout", None, None, None, None, None, None, False), ("test", "t2", "Refused", True, False, False, None, 20.0, 7.0, False), ("test", "t3", None, False, True, True, False, 30.0, 9.0, True)]
    make = lambda rows: spark.createDataFrame(rows, AUDIT)
    got = {r["fold"]: r for r in evaluation.whole_text_audit(make(rows), {"val": 5, "test": 4}).collect()}
    t, v = got["test"], got["val"]
    assert (t["n_expected"], t["n_attempted"], t["n_errors"], t["error_counts"]) == (4, 4, 3, {"Refused": 1, "Timeout": 2}) and v["error_counts"] == {}
    assert (t["n_valid_format"], t["valid_format_rate"], t["n_no_usable_text"], t["n_comparable"], t["disagreement_rate"], t["n_not_comparable"]) == (1, 0.25, 3, 1, 0.0, 3)
    assert tuple(t["api_ms_all"]) == (3, 30.0, float(np.percentile([900, 20, 30], 95)), 20.0, 900.0) and tuple(t["api_ms_paid"]) == (1, 30.0, 30.0, 30.0, 30.0)
    assert tuple(t["generation_ms_all"])[0] == 2 and tuple(v["api_ms_all"]) == (5, 20.0, 38.0, 0.0, 40.0) and v["correct_band_rate"] == 0.6
    for wrong, fold in ((rows[:-1], "test"), ([*rows, rows[-1]], "test"), ([*rows[1:], rows[1]], "val"), ([*rows, ("train", "x", *rows[0][2:])], "train")):
        with pytest.raises(ValueError, match=fold):
            evaluation.whole_text_audit(make(wrong), {"val": 5, "test": 4})
    none = evaluation.whole_text_audit(make([("val", "v", "Timeout", None, None, None, None, None, None, False)]), {"val": 1}).first()
    assert tuple(none["api_ms_paid"] or (0,))[0] == 0 and none["n_errors"] == 1


def test_recordings_hang_on_a_chain(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "recording string, sha256 string")
    inputs = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "recording string, input_sha256 string")
    visuals = spark.createDataFrame([("1", "v1"), ("1", "v1"), ("9", "v9")], "input_sha256 string, visual string")
    got = {r["recording"]: (r["visual"], r["problem"]) for r in invariants.identity_chain(files, inputs, visuals).collect()}
    assert got == {"a": ("v1", None), "b": ("v9", "other input"), "c": (None, "no input"), "d": (None, "no display")}


def test_incidents_on_a_clock(spark):
    rows = spark.createDataFrame([(1, 10.0, None, 40.0), (2, 0.5, 20.25, None)], "id int, started_at double, resolved_at double, confirmed_at double")
    got = {r["id"]: (r["k0"], r["k1"], r["confirmed_k"]) for r in timeline.on_clock(rows, F.floor(F.col("at") * 4)).collect()}
    assert got == {1: (40, None, 160), 2: (2, 81, None)}


def test_routes_are_compared_with_one(spark):
    rows = [("c", "ref", [1.0, 2.0]), ("c", "a", [1.0, 2.0]), ("c", "b", [1.0, 2.5]), ("c", "short", [1.0]), ("d", "ref", []), ("d", "a", [])]
    got = {(r["clip_id"], r["route"]): r for r in evaluation.compare_routes(spark.createDataFrame(rows, "clip_id string, route string, x array<double>"), "ref").collect()}
    assert set(got) == {("c", "a"), ("c", "b"), ("c", "short"), ("d", "a")} and got["c", "a"]["exact"] and got["d", "a"]["exact"]
    b = got["c", "b"]
    assert (b["same_shape"], b["exact"], b["n_different"], b["max_abs"], b["mean_abs"], b["at"]) == (True, False, 1, 0.5, 0.25, 1)
    assert not got["c", "short"]["same_shape"] and not got["c", "short"]["exact"] and got["c", "short"]["max_abs"] is None


def test_reports_have_their_order_and_signs(spark):
    runs = spark.createDataFrame([(x,) for x in ("z", "c3", "a", "c2b", "c0", "c2")], "run string")
    assert [r["run"] for r in evaluation.in_report_order(runs).collect()] == ["c0", "c2", "c2b", "c3", "a", "z"]
    values = spark.createDataFrame([(0.12345,), (-0.5,), (0.0,)], "v double").select(evaluation.signed(F.col("v"))).collect()
    assert [r[0] for r in values] == ["+0.123", "-0.500", "+0.000"]
    s = spark.range(1).select(evaluation.stretches(0.1, 0.9, ("low", 2), ("high", 3), ("low", 1))).first()[0]
    assert s == [0.1, 0.1, 0.9, 0.9, 0.9, 0.1]


def test_quantiles_are_those_of_the_sql_to_the_last_bit(spark):
    """Quartiles of which a rounding more or less would decide; null keys and values, single rows and keys without any value."""
    data = [("a", v) for v in (0.0885, 0.1)] + [("b", v) for v in (0.1166, 0.2)] + [("c", v) for v in (0.1, 0.1974)] + [(None, 0.5), (None, 2.5), ("d", 3.0), ("e", None), ("f", 1.0), ("f", None)]
    data += [("g", (k * 37 % 1000) / 100) for k in range(1001)]
    frame = pd.DataFrame(data, columns=["k", "v"])
    want = expected("SELECT k, quantile_cont(v, 0.25) AS q, quantile_cont(v, 0.95) AS r FROM t WHERE v IS NOT NULL GROUP BY k", t=frame)
    rows_of = spark.createDataFrame(data, "k string, v double")
    assert rows(ranking.quantiles(rows_of, ["k"], "v", {"q": 0.25, "r": 0.95}).toPandas()) == rows(want)
    told = evaluation.latency_summary(rows_of, ["k"], "v").toPandas()
    want = expected("SELECT k, count(v) AS n, quantile_cont(v, 0.5) AS median_ms, quantile_cont(v, 0.95) AS p95_ms, min(v) AS min_ms, max(v) AS max_ms FROM t GROUP BY k", t=frame)
    assert rows(told) == rows(want)


def test_summary_takes_no_map_of_all_values(spark):
    """A key's values are put in order by ranges, not gathered in one task."""
    plan = evaluation.latency_summary(spark.range(10).selectExpr("'x' AS k", "cast(id AS double) AS v"), ["k"], "v")._jdf.queryExecution().toString()
    assert "percentile(" not in plan
