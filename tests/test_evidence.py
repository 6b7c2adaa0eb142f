"""Results read all or nothing, chains of digests, versioned caches, scoring by callbacks: each rule with a case that breaks it."""

import copy
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoline.operators import evaluation, evidence, scoring
from echoline.sources import cache
from echoline.sources.manifests import ManifestError

# --- results ------------------------------------------------------------------------------------------------------
PROTOCOL = evidence.Protocol("freeze", "c" * 40, "split.csv", "d" * 64)
SHOWN = {"c0": (0.878, 0.839), "c1": (0.902, 0.927), "c2": (0.71, 0.779), "c2b": (0.847, 0.915), "c3": (0.824, 0.9)}


def a_run(name, clip=0.66, cluster=0.86):
    side = {"ci95_low": 0.5, "ci95_high": 0.9}
    test = {
        "n_clips": 194, "n_clusters": 41, "n_clusters_leak": 30, "n_clusters_non_leak": 11, "clip_level": {"roc_auc": clip, "pr_auc": 0.7, "macro_f1": 0.6, "brier": 0.2},
        "cluster_level": {"roc_auc": cluster, "macro_f1": 0.5}, "bootstrap_ci95": {"clip_roc_auc": side, "cluster_roc_auc": side},
    }
    return {"run_id": name, "model_name": "model", "checkpoint": None, "training_commit": "abc", "folds": {"test": test}}


def a_pair(a, b, clip="inconclusive", cluster="inconclusive"):
    delta = lambda x: {"delta_observe": -0.1, "ci95_low": -0.2, "ci95_high": 0.05, "lecture": x}
    return {"a": a, "b": b, "fold": "test", "n_clusters": 41, "clip_roc_auc": delta(clip), "cluster_roc_auc": delta(cluster)}


def a_drop():
    receipt = PROTOCOL.receipt() | {"tslm_run_id": "m-1", "metrics_sha256": "a" * 64, "comparison_sha256": "b" * 64}
    runs = {c: a_run(c, clip + 0.0003, cluster - 0.0004) for c, (clip, cluster) in SHOWN.items()} | {"m-1": a_run("m-1"), "m-1.T2": a_run("m-1.T2", 0.6, 0.7), "other-T1": a_run("other-T1")}
    metrics = {
        "split": {"filename": "split.csv", "sha256": "d" * 64}, "control_ladder": list(SHOWN), "runs": runs, "tslm_run_id": "m-1",
        "stress_run_bases": {"m-1.T2": ["m-1", "T2"], "other-T1": ["other", "T1"]}, "stress_comparisons": {"m-1_vs_m-1.T2": a_pair("m-1", "m-1.T2", "compatible with improvement")},
    }
    comparison = {f"m-1_vs_{c}": a_pair("m-1", c, "compatible with degradation" if c == "c1" else "inconclusive") for c in SHOWN}
    return {"receipt": receipt, "metrics": metrics, "comparison": comparison}


def read(spark, drop, **how):
    rows = [(f"{k}.json", v if isinstance(v, str) else json.dumps(v)) for k, v in drop.items() if v is not None]
    return evidence.official_result(spark.createDataFrame(rows, "name string, content string"), PROTOCOL, SHOWN, 41, 11, **how)


def test_a_whole_result_is_read(spark):
    r = read(spark, a_drop()).first()
    assert (r["status"], r["reason"]) == ("OFFICIAL", None)
    x = r["result"]
    assert (x["run_id"], x["n_clips"], x["n_clusters_non_leak"], x["clip_roc_auc"], x["cluster_macro_f1"], x["clip_auc_ci"]) == ("m-1", 194, 11, 0.66, 0.5, [0.5, 0.9])
    assert [v["control"] for v in x["versus"]] == list(SHOWN) and x["versus"][1]["clip"]["reading"] == "compatible with degradation" and x["versus"][0]["cluster"]["low"] == -0.2
    assert [(s["transform"], s["run_id"], s["clip_auc"], s["clip_verdict"], s["cluster_verdict"]) for s in x["stress"]] == [("T2", "m-1.T2", 0.6, "compatible with degradation under stress", "inconclusive")]
    assert x["outcome"] == "degradation"


def broken(path, value=None):
    """A change of a drop: sets the value at a path of keys, or removes it for ``...``."""

    def change(drop):
        at = drop
        for k in path[:-1]:
            at = at[k]
        if value is ...:
            del at[path[-1]]
        else:
            at[path[-1]] = value

    return change


RUN, T = ("metrics", "runs", "m-1"), ("metrics", "runs", "m-1", "folds", "test")
CASES = [
    ("Receipt missing or invalid.", [broken(("receipt",)), broken(("receipt",), "{"), broken(("receipt", "status"), "DRAFT"), broken(("receipt", "more"), 1), broken(("receipt", "tslm_run_id"), "a b"),
        broken(("receipt", "metrics_sha256"), "A" * 64), broken(("receipt", "protocol_commit"), "e" * 40), broken(("receipt", "contract_check"), ...), broken(("receipt", "comparison_sha256"), 7)]),
    ("metrics.json invalid.", [broken(("metrics",)), broken(("metrics",), "[1"), broken((*T, "n_clips"), 0), broken((*T, "n_clips"), 1.5), broken((*T, "clip_level", "roc_auc"), 1.01), broken((*T, "clip_level", "brier"), "0.2"),
        broken((*T, "bootstrap_ci95", "clip_roc_auc", "ci95_low"), ...), broken((*RUN, "model_name"), ""), broken((*RUN, "checkpoint"), ...), broken((*RUN, "training_commit"), 3), broken(("metrics", "runs", "c2", "folds"), {}),
        broken(("metrics", "stress_run_bases", "m-1.T2"), ["m-1", "T9"]), broken(("metrics", "stress_run_bases", "m-1.T2"), ["m-1"]), broken(("metrics", "stress_comparisons", "m-1_vs_m-1.T2", "fold"), "val"),
        broken(("metrics", "tslm_run_id"), "-x"), broken(("metrics", "split", "sha256"), None), broken(("metrics", "runs"), [])]),
    ("comparison.json invalid.", [broken(("comparison",)), broken(("comparison",), "3"), broken(("comparison", "m-1_vs_c0", "clip_roc_auc", "lecture"), "better"), broken(("comparison", "m-1_vs_c0", "cluster_roc_auc", "ci95_low"), None), broken(("comparison", "x"), {})]),
    ("Synthetic fixture refused.", [broken((*RUN, "model_name"), "SYNTHETIC model")]),
    ("Report has no TSLM run.", [broken(("metrics", "tslm_run_id"), None)]),
    ("Receipt and report name different TSLM runs.", [broken(("receipt", "tslm_run_id"), "m-2")]),
    ("Control ladder differs from the frozen ladder.", [broken(("metrics", "control_ladder"), ["c0", "c1"]), broken(("metrics", "control_ladder"), ["c1", "c0", "c2", "c2b", "c3"])]),
    ("Report is not on the frozen split.", [broken(("metrics", "split", "filename"), "other.csv"), broken(("metrics", "split", "sha256"), "e" * 64)]),
    ("TSLM run missing from metrics.json.", [broken(RUN, ...)]),
    ("Control c1 differs from the displayed evidence.", [broken(("metrics", "runs", "c1", "folds", "test", "clip_level", "roc_auc"), 0.91), broken(("metrics", "runs", "c1"), ...)]),
    ("TSLM and c3 test populations differ.", [broken(("metrics", "runs", "c3", "folds", "test", "n_clips"), 193)]),
    ("Test cluster counts differ from the displayed evidence.", [broken((*T, "n_clusters_non_leak"), 12)]),
    ("Paired comparison m-1 vs c2b missing.", [broken(("comparison", "m-1_vs_c2b"), ...), broken(("comparison", "m-1_vs_c2b", "b"), "c2")]),
    ("Stress run m-1.T2 incomplete.", [broken(("metrics", "runs", "m-1.T2"), ...), broken(("metrics", "stress_comparisons", "m-1_vs_m-1.T2"), ...), broken(("metrics", "stress_comparisons", "m-1_vs_m-1.T2", "a"), "m")]),
    ("Stress run m-1.T2 test population differs.", [broken(("metrics", "runs", "m-1.T2", "folds", "test", "n_clusters"), 40)]),
]


def test_every_rule_refuses_the_whole(spark):
    """All cases in one table of drops: each is refused whole, by the rule it breaks."""
    rows, want = [], {}
    for reason, changes in CASES:
        for i, change in enumerate(changes):
            drop = copy.deepcopy(a_drop())
            change(drop)
            name = f"{reason} {i}"
            want[name] = reason
            rows += [(name, f"{k}.json", v if isinstance(v, str) else json.dumps(v)) for k, v in drop.items() if v is not None]
    rows += [("good", f"{k}.json", json.dumps(v)) for k, v in a_drop().items()]
    files = spark.createDataFrame(rows, "drop string, name string, content string")
    got = {r["drop"]: r for r in evidence.official_result(files, PROTOCOL, SHOWN, 41, 11, by=["drop"]).collect()}
    assert got.pop("good")["status"] == "OFFICIAL"
    assert {k: r["reason"] for k, r in got.items()} == want and all(r["status"] == "NOT_EVALUATED" and r["result"] is None for r in got.values())


def test_other_refusals_and_fixtures(spark):
    assert read(spark, {"notes": "x"}).first()["reason"] == "No official TSLM result delivered."
    drop = a_drop()
    broken((*RUN, "model_name"), "SYNTHETIC")(drop)
    assert read(spark, drop, allow_fixture=True).first()["status"] == "OFFICIAL"
    text = json.dumps(a_drop()).replace('"m-1', '"C1').replace("m-1_vs", "C1_vs")
    assert read(spark, json.loads(text)).first()["reason"] == "TSLM run id collides with a control."
    two = a_drop()
    broken(("comparison", "m-1_vs_c0"), ...)(two)
    broken(("metrics", "split", "filename"), "x")(two)  # the rule that comes first names the state
    assert read(spark, two).first()["reason"] == "Report is not on the frozen split."


def test_gates(spark):
    good = {"clip_ids": ["a", "b"], "amplitude_evidence": True, "scoring_spec": {"version": "vC", "acoustic_batching": "one_clip_four_channels"}, "test_audio_or_cache_opened": False, "quality_metrics_calculated": False, "amplitude_tokens": {"b": 1, "a": 2}}
    cases = [(None, None), ("clip_ids", ["b", "a"]), ("amplitude_evidence", 1), ("version", None), ("batching", None), ("test_opened", True), ("metrics_calculated", None), ("amplitude_tokens", {"a": 1})]
    keys = {"test_opened": "test_audio_or_cache_opened", "metrics_calculated": "quality_metrics_calculated"}
    rows = []
    for name, value in cases:
        g = copy.deepcopy(good)
        if name in ("version", "batching"):
            g["scoring_spec"] = {k: v for k, v in g["scoring_spec"].items() if not k.endswith(name)}
        elif name:
            g[keys.get(name, name)] = value
        rows.append((name, json.dumps(g)))
    df = spark.createDataFrame([*rows, ("json", "nope")], "name string, gate string")
    problem = evidence.gate_problem(F.col("gate"), F.array(F.lit("a"), F.lit("b")), "C", {"C": "vC", "A": "vA"})
    assert all(r["name"] == r["p"] for r in df.select("name", problem.alias("p")).collect())
    a = {**good, "amplitude_evidence": False, "scoring_spec": {**good["scoring_spec"], "version": "vA"}}
    one = spark.createDataFrame([(json.dumps(a),)], "gate string").select(evidence.gate_problem(F.col("gate"), F.array(F.lit("a"), F.lit("b")), "A", {"C": "vC", "A": "vA"})).first()
    assert one[0] is None


# --- chains -------------------------------------------------------------------------------------------------------
def spaced(x):
    return json.dumps(x, indent=3)


def a_chain():
    sha = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    identity = {"model": "m", "config": "c"}
    receipt = {"fit_fold": "val", "threshold": 0.8123456789012345, "threshold_repr": "0.8123456789012345", "rule": "macro", "split_sha256": "d" * 64, "validation_predictions_sha256": "e" * 64, "threshold_method_sha256": "f" * 64, "model": {"sha256": sha(identity)}}
    decision = {"version": "v1", "evidence_sha256": sha(receipt), "identity_sha256": sha(identity)}
    run = {"decision_sha256": sha(decision), "transform": "T0"}
    return {"identity": identity, "receipt": receipt, "decision": decision, "run": run}


LINKS = [(1, "receipt", "model.sha256", "identity"), (2, "decision", "evidence_sha256", "receipt"), (3, "decision", "identity_sha256", "identity"), (4, "run", "decision_sha256", "decision")]


def bound(spark, artifacts, more=()):
    rows = [(k, v if isinstance(v, str) else spaced(dict(reversed(v.items())))) for k, v in artifacts.items() if v is not None]
    return evidence.bound_threshold(spark.createDataFrame([*rows, *more], evidence.ARTIFACTS), spark.createDataFrame(LINKS, evidence.LINKS), "receipt", "macro", "d" * 64, "f" * 64)


def test_a_threshold_is_used_only_at_the_end_of_a_whole_chain(spark):
    assert bound(spark, a_chain()) == 0.8123456789012345
    for name, link, why in (("identity", "receipt.model.sha256", "other digest"), ("receipt", "decision.evidence_sha256", "other digest"), ("decision", "run.decision_sha256", "other digest")):
        x = a_chain()
        x[name]["more"] = 1
        with pytest.raises(ValueError, match=f"link {link} is broken: {why}"):
            bound(spark, x)
    for name, value, link, why in (("decision", None, "decision.evidence_sha256", "missing"), ("run", "{", "run.decision_sha256", "not JSON"), ("identity", None, "receipt.model.sha256", "missing")):
        with pytest.raises(ValueError, match=f"link {link} is broken: {why}"):
            bound(spark, a_chain() | {name: value})
    x = a_chain()
    del x["run"]["decision_sha256"]
    with pytest.raises(ValueError, match="link run.decision_sha256 is broken: no digest"):
        bound(spark, x)
    with pytest.raises(ValueError, match="link run.decision_sha256 is broken: ambiguous"):
        bound(spark, a_chain(), [("run", "{}")])


@pytest.mark.parametrize("field, value", [("fit_fold", "test"), ("threshold", "0.8"), ("threshold_repr", "0.812346"), ("rule", "other"), ("split", None), ("predictions", "e"), ("method", "g" * 64)])
def test_a_receipt_that_is_bound_may_still_be_refused(spark, field, value):
    key = {"split": "split_sha256", "predictions": "validation_predictions_sha256", "method": "threshold_method_sha256"}.get(field, field)
    x = a_chain()
    x["receipt"][key] = value
    sha = lambda v: hashlib.sha256(json.dumps(v, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    x["decision"]["evidence_sha256"] = sha(x["receipt"])
    x["run"]["decision_sha256"] = sha(x["decision"])
    with pytest.raises(ValueError, match=f"receipt receipt is refused: {field}$"):
        bound(spark, x)


def test_a_run_is_the_frozen_one(spark):
    make = lambda rows: spark.createDataFrame(rows, "clip_id string, p double")
    a = make([("a", 0.1), ("b", 0.30000000000000004), ("c", 0.5)])
    assert evidence.unchanged_run(a, a.repartition(3)).collect() == []
    got = evidence.unchanged_run(a, make([("a", 0.1), ("b", 0.3), ("d", 0.5)])).collect()
    assert {tuple(r) for r in got} == {("b", "other score"), ("c", "missing"), ("d", "unknown")}


def test_thresholds_are_declared_in_full(spark):
    declared = spark.createDataFrame([("a", 0.123456789, 0.123457), ("b", 0.123457, 0.123457), ("c", 0.5, 0.6), ("d", 0.5, 0.5)], "run string, threshold double, reported double")
    full = spark.createDataFrame([("a", 0.123456789), ("b", 0.123456789), ("c", 0.5)], "run string, threshold double")
    got = {r["name"]: r["failures"] for r in evaluation.threshold_checks(declared, full).collect()}
    assert got == {"exact_threshold": 2, "reported_threshold": 2}  # b is the rounded form, c is misreported, d was not recomputed


# --- caches -------------------------------------------------------------------------------------------------------
CLIPS = "clip_id string, fold string, samples array<double>"


def doubled(calls, factor=2.0):
    def build(rows):
        calls.append(sorted(r["fold"] for r in rows.select("fold").distinct().collect()))
        return rows.select("clip_id", "fold", F.transform("samples", lambda v: v * factor).alias("series"))

    return build


def test_only_changed_folds_are_rebuilt(spark, tmp_path):
    path, calls = f"{tmp_path}/cache", []
    rows = [(f"c{i}", ("train", "validation")[i % 2], [float(i), 0.1 * i]) for i in range(20)]
    make = lambda rows: spark.createDataFrame(rows, CLIPS)
    assert cache.refresh(make(rows), path, "v1", doubled(calls)) == ["train", "validation"]
    assert cache.refresh(make(rows[::-1]).repartition(5), path, "v1", doubled(calls)) == [] and len(calls) == 1
    ids = make(rows).filter("fold = 'train'")
    kept = cache.load(spark, path, "train", ids, "v1").collect()
    assert {r["clip_id"]: r["series"] for r in kept} == {c: [2 * v for v in x] for c, f, x in rows if f == "train"}
    changed = [*rows[:-1], ("c19", "validation", [19.0, 1.9000000001])]
    assert cache.refresh(make(changed), path, "v1", doubled(calls)) == ["validation"] and calls[-1] == ["validation"]
    assert cache.recomputed(spark, path, make(changed), doubled([]), "validation").first()["passed"]
    wrong = cache.recomputed(spark, path, make(rows), doubled([]), "validation").first()
    assert not wrong["passed"] and wrong["failures"] == 2 and not cache.recomputed(spark, path, make(changed), doubled([], 2.0000001), "train").first()["passed"]
    assert cache.refresh(make(changed), path, "v2", doubled(calls)) == ["train", "validation"]
    for args, why in ((("test", ids, "v2"), "not for this cache"), (("train", ids, "v1"), "has version v2, not v1"), (("train", ids.limit(3), "v2"), "not those wanted"), (("train", make(rows), "v2"), "not those wanted")):
        with pytest.raises(ManifestError, match=why):
            cache.load(spark, path, *args)
    with pytest.raises(ManifestError, match="broken rows"):
        cache.load(spark, path, "train", ids, "v2", problem=F.get("series", F.lit(0)) > 20)
    with pytest.raises(ManifestError, match="no receipt"):
        cache.load(spark, f"{tmp_path}/none", "train", ids, "v1")
    spark.createDataFrame([("c0", [0.0], "v2")], "clip_id string, series array<double>, version string").write.mode("append").parquet(f"{path}/data/fold=train")
    with pytest.raises(ManifestError, match="not what its receipt says"):
        cache.load(spark, path, "train", ids, "v2")
    with pytest.raises(ManifestError, match="lacks its fold"):
        cache.refresh(make([("x", None, [])]), path, "v1", doubled(calls))


def test_a_fold_cut_short_is_rebuilt(spark, tmp_path, monkeypatch):
    path, rows = f"{tmp_path}/cache", spark.createDataFrame([("a", "train", [1.0])], CLIPS)
    write = cache._write
    with monkeypatch.context() as m:
        m.setattr(cache, "_write", lambda r, p: write(r, p) if p.endswith("data") else (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            cache.refresh(rows, path, "v1", doubled([]))
    assert cache.refresh(rows, path, "v1", doubled([])) == ["train"]


def test_digests_of_content(spark):
    rows = [("a", 1, [0.1, float("nan")]), ("a", 2, None), ("b", 1, [0.1, -0.0])]
    one = lambda rows: {r["k"]: (r["rows"], r["digest"]) for r in cache.content_digest(spark.createDataFrame(rows, "k string, n int, x array<double>").repartition(3), ["k"]).collect()}
    base = one(rows)
    assert base == one(rows[::-1]) and base["a"][0] == 2 and one([*rows, rows[0]])["a"] != base["a"]
    assert one([rows[0], rows[1], ("b", 1, [0.1, 0.0])])["b"] != base["b"] and one([("a", 1, [0.1, None]), *rows[1:]])["a"] != base["a"]


def test_broken_series_are_told(spark):
    good = [[1.0] * 61 + [0.0] * 3] * 4
    bad = [None, good[:3], [x[:63] for x in good], [[-1.0, *good[0][1:]], *good[1:]], [[1.0] * 62 + [0.0] * 2, *good[1:]], [[float("nan"), *good[0][1:]], *good[1:]]]
    got = spark.createDataFrame([(s,) for s in [good, *bad]], "s array<array<double>>").select(cache.series_problem(F.col("s")).alias("p")).collect()
    assert [r["p"] for r in got] == [False] + [True] * len(bad)


# --- scoring ------------------------------------------------------------------------------------------------------
def level_scorer():
    return lambda x: 1 / (1 + np.exp(-np.sqrt((x * x).mean(axis=1))))


def clips(spark, n=50, size=16):
    rng = np.random.default_rng(0)
    return spark.createDataFrame([(f"c{i}", rng.normal(size=size).tolist()) for i in range(n)], "clip_id string, samples array<double>").repartition(8)


def test_scores_equal_one_by_one(spark):
    df = clips(spark).unionByName(spark.createDataFrame([("none", None), ("short", [1.0]), ("nan", [float("nan")] * 16)], "clip_id string, samples array<double>"))
    got = {r["clip_id"]: (r["p"], r["problem"]) for r in scoring.scored(df, level_scorer, samples=16).collect()}
    for r in df.collect():
        if r["clip_id"].startswith("c"):
            assert got[r["clip_id"]] == (pytest.approx(float(level_scorer()(np.array([r["samples"]]))[0])), None)
    assert got["none"] == got["short"] == got["nan"] == (None, "input")


def test_only_samples_reach_the_scorer(spark):
    df = clips(spark, 5)
    with pytest.raises(ValueError, match="not allowed: label"):
        scoring.scored(df.withColumn("label", F.lit(1)), level_scorer, samples=16)
    with pytest.raises(ValueError, match="missing: samples"):
        scoring.scored(df.drop("samples"), level_scorer)

    def spying():
        def score(x):
            assert type(x) is np.ndarray and x.dtype == float and x.ndim == 2
            return np.full(len(x), 0.5)

        return score

    assert scoring.scored(df, spying, samples=16).filter("p = 0.5").count() == 5
    for wrong, why in ((lambda: lambda x: np.zeros(len(x) + 1), "scores for"), (lambda: lambda x: np.full(len(x), 1.5), "outside"), (lambda: lambda x: np.full(len(x), np.nan), "outside")):
        with pytest.raises(Exception, match=why):
            scoring.scored(df, wrong, samples=16).collect()


def test_a_model_is_built_once_in_a_worker(spark, tmp_path):
    log = f"{tmp_path}/built"

    def build():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return level_scorer()

    df = clips(spark, 400).repartition(60)
    assert scoring.scored(df, build, samples=16).filter("p is not null").count() == 400
    pids = open(log).read().split()
    assert len(pids) == len(set(pids)) < 60


def test_real_batches_tell_a_scorer_that_depends_on_them(spark):
    df, routes = clips(spark, 41), 2 * len(evaluation.BATCH_SIZES)
    good = evaluation.batch_invariance(scoring.by_routes(df, level_scorer), routes).first()
    assert (good["n"], good["beyond"], good["flips"], good["faulty"]) == (41, 0, 0, 0)
    centred = lambda: lambda x: 1 / (1 + np.exp(-np.sqrt(((x - x.mean()) ** 2).mean(axis=1))))
    first = lambda: lambda x: np.where(np.arange(len(x)) == 0, 0.9, 0.1)
    for scorer in (centred, first):
        bad = evaluation.batch_invariance(scoring.by_routes(df, scorer), routes).first()
        assert bad["beyond"] > 0
    sizes = {}

    def sized():
        return lambda x: np.full(len(x), len(x) / 10)

    for r in scoring.by_routes(df, sized).collect():
        sizes.setdefault(r["route"], set()).add(round(r["p"] * 10))
    assert sizes["batch_4_forward"] == {4, 1} and sizes["batch_2_reversed"] == {2, 1} and sizes["batch_1_forward"] == {1}


def measured():
    measure = lambda x: np.stack([x.mean(axis=1), x.std(axis=1), np.abs(x).max(axis=1)], axis=1)
    return measure, lambda m: 1 / (1 + np.exp(-m[:, 1]))


def test_a_recording_becomes_a_matrix(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = {f"r{i}": rng.normal(size=5 * 8) for i in range(6)}
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in x.items()] + [("short", [1.0] * 39), ("null", None)], "recording string, samples array<double>").repartition(3)
    got = {r["recording"]: r for r in scoring.recording_matrix(rows, measured, windows=5, samples=8).collect()}
    assert got["short"]["problem"] == got["null"]["problem"] == "input" and got["short"]["matrix"] is None
    for k, v in x.items():
        measure, score = measured()
        m = measure(v.reshape(5, 8))
        assert np.allclose(got[k]["matrix"], np.column_stack([m, score(m)])) and np.shape(got[k]["matrix"]) == (5, 4)
    files = {k: v.astype("<f8").tobytes() for k, v in x.items()}
    content = spark.createDataFrame([(f"{k}.bin", bytearray(v)) for k, v in files.items()], "path string, content binary")
    declared = [(k, f"{k}.bin", hashlib.sha256(v).hexdigest(), "leak", "train" if k != "r5" else "confirmation") for k, v in files.items()]
    schema = "recording string, path string, sha256 string, label string, partition string"
    loaded = {r["recording"]: r["samples"] for r in scoring.verified(spark.createDataFrame(declared, schema), content, "train").collect()}
    assert loaded == {k: v.tolist() for k, v in x.items() if k != "r5"}
    with pytest.raises(ValueError, match="confirmation"):
        scoring.verified(spark.createDataFrame([*declared, ("gone", "gone.bin", "0" * 64, "leak", "confirmation")], schema), content, "confirmation")
    with pytest.raises(ValueError, match="train"):
        scoring.verified(spark.createDataFrame(declared, schema), content.withColumn("content", F.concat("content", F.lit(b"\0"))), "train")
