"""Manifests, sinks, replay, incidents, overlaps and displays against small plain versions."""

import json
import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echoline.functions import display, narration, series, stress
from echoline.operators import metrics, overlap, resampling
from echoline.sources import manifests, sinks
from echoline.streaming import incidents, replay

SPLIT = "clip_id string, label string, group_id string, fold string"
META = dict.fromkeys(sinks.METADATA, "x") | {"test_labels_not_used_for_tuning": True, "split_sha256": "s"}


def test_strict_csv(spark, tmp_path):
    path = tmp_path / "split.csv"
    path.write_text("clip_id,label,group_id,fold\na,leak,g,train\nb,no_leak,h,test\n")
    digest = manifests.file_digests(spark, str(path)).first()["sha256"]
    assert manifests.frozen_csv(spark, str(path), SPLIT, "clip_id", digest).count() == 2
    with pytest.raises(manifests.ManifestError, match="frozen"):
        manifests.frozen_csv(spark, str(path), SPLIT, "clip_id", "0" * 64)
    with pytest.raises(manifests.ManifestError, match="header"):
        manifests.strict_csv(spark, str(path), "clip_id string, label string", "clip_id")
    path.write_text("clip_id,label,group_id,fold\na,leak,g,train\na,leak,g,train\n")
    spark.catalog.refreshByPath(str(path))
    with pytest.raises(manifests.ManifestError, match="unique"):
        manifests.strict_csv(spark, str(path), SPLIT, "clip_id")


def test_split_checks(spark):
    rows = [("a", "leak", "g", "train"), ("b", "no_leak", "g", "test"), ("b", "odd", "h", "test")]
    got = {r["name"]: r["failures"] for r in manifests.split_checks(spark.createDataFrame(rows, SPLIT)).collect()}
    assert got == {"unique_clip": 1, "known_fold": 0, "known_label": 1, "group_in_one_fold": 1, "group_of_one_label": 1}


def test_grid_windows_and_coverage(spark):
    clips = manifests.window_table(manifests.recording_grid(spark))
    assert clips.count() == 122 * 30 == clips.select("clip_id").distinct().count()
    assert manifests.coverage_gaps(clips).isEmpty()
    first = clips.select("recording_id").first()[0]
    lost = manifests.coverage_gaps(clips.filter((F.col("recording_id") != first) | (F.col("start_sample") > 0))).collect()
    assert [r["recording_id"] for r in lost] == [first]


def test_paths_and_archives(spark, tmp_path):
    cases = {"a/b.wav": True, "../a": False, "a/../b": False, "/a": False, "c:/a": False, "a\\b": False, "": False, "a//b": False}
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", manifests.safe_path(F.col("p")).alias("s"))
    assert {r["p"]: r["s"] for r in df.collect()} == cases
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a/b.raw", b"123")
        z.writestr("../c.raw", b"1")
    found = manifests.zip_inventory(spark, str(tmp_path))
    assert {(r["member"], r["bytes"], r["safe"]) for r in found.collect()} == {("a/b.raw", 3, True), ("../c.raw", 1, False)}
    declared = spark.createDataFrame([("a/b.raw",), ("d.raw",)], "member string")
    assert {(r["member"], r["side"]) for r in manifests.inventory_difference(found, declared, "member").collect()} == {("../c.raw", "found"), ("d.raw", "declared")}


def scenario(**more):
    entry = lambda i: {"path": f"{i}.wav", "audio_sha256": "a" * 64, "provenance": "synthetic", "source_offset_samples": 8000 * i}
    return {"schema_version": 1, "device_id": "d", "source_mode": "development_fixture", "consumer_seconds": 0.0, "entries": [entry(i) for i in range(8)], "incidents": []} | more


def test_scenarios(spark, tmp_path):
    close = scenario()["entries"]
    close[1] = close[1] | {"source_offset_samples": 7999}
    cases = {
        "a": (scenario(), None), "b": (scenario(source_mode="live"), "source_mode"), "c": (scenario(entries=close), "offsets"), "d": (scenario(entries=[]), "entries"),
        "e": (scenario(source_mode="replay"), "provenance"), "f": (scenario(incidents=[{"sequence": 8, "kind": "drop"}]), "incident_sequence"),
        "g": (scenario(incidents=[{"sequence": 1, "kind": "delay"}]), "delay"), "h": (scenario(incidents=[{"sequence": 1, "kind": "odd"}]), "incident_kind"),
        "i": (scenario(incidents=[{"sequence": 1, "kind": "drop"}] * 2), "incident_sequence"), "j": (scenario(consumer_seconds=-1.0), "consumer_seconds"), "k": (scenario(device_id=""), "device_id"),
    }
    for name, (s, _) in cases.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(s))
    got = {r["file"][-6]: r["problem"] for r in manifests.read_scenarios(spark, str(tmp_path)).select("file", "problem").collect()}
    assert got == {name: problem for name, (_, problem) in cases.items()}


def test_runs_round_trip(spark, tmp_path):
    scores = spark.createDataFrame([(f"c{i:03d}", 1 / (i + 3)) for i in range(50)], "clip_id string, p double")
    sinks.write_run(scores, f"{tmp_path}/exact", META, exact=True)
    sinks.write_run(scores, f"{tmp_path}/short", META)
    rows, meta = sinks.read_run(spark, f"{tmp_path}/exact", "x", "s")
    assert rows.exceptAll(scores).isEmpty() and rows.count() == 50 and meta == META
    assert sinks.read_run(spark, f"{tmp_path}/short")[0].orderBy("clip_id").first()["p"] == 0.3333333333
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_run(scores, f"{tmp_path}/exact", META)
    for bad in (META | {"run_id": ""}, META | {"test_labels_not_used_for_tuning": False}):
        with pytest.raises(manifests.ManifestError):
            sinks.write_run(scores, f"{tmp_path}/bad", bad)
    for values in ([("a", 1.5)], [("a", None)], [("a", float("nan"))], [("a", 0.1), ("a", 0.2)]):
        with pytest.raises(manifests.ManifestError):
            sinks.write_run(spark.createDataFrame(values, "clip_id string, p double"), f"{tmp_path}/bad", META)
    with pytest.raises(manifests.ManifestError, match="split"):
        sinks.read_run(spark, f"{tmp_path}/exact", "other")
    sinks.write_receipt(spark, f"{tmp_path}/short", f"{tmp_path}/receipt", stage="a")
    assert sinks.receipt_holds(spark, f"{tmp_path}/short", f"{tmp_path}/receipt", stage="a")
    assert not sinks.receipt_holds(spark, f"{tmp_path}/short", f"{tmp_path}/receipt", stage="b")
    assert not sinks.receipt_holds(spark, f"{tmp_path}/exact", f"{tmp_path}/receipt", stage="a")


def log(*arrivals, busy=0.0):
    return [(e, q, r) for _, e, q, r in replay.deliver(arrivals, busy)]


def test_mailbox():
    one = lambda t, q, fault=None: (t, [(q, fault)])
    assert [e for e, *_ in log(one(1.0, 0), one(2.0, 1))] == ["emitted", "processing", "received"] * 2
    slow = log(*[one(float(i + 1), i) for i in range(4)], busy=3.0)
    assert ("lost", 1, "replaced_pending") in slow and [q for e, q, _ in slow if e == "received"] == [0, 3]
    assert ("lost", 2, "older_than_pending") in log(one(1.0, 0), one(2.0, 3), one(2.5, 2), busy=9.0)
    assert log((1.0, [(0, "duplicate"), (0, "duplicate")]))[1:3] == [("emitted", 0, None), ("duplicate", 0, "ignored")]
    assert log(one(1.0, 0, "drop")) == [("lost", 0, "transport_cut")]


def test_replay_accounts_for_every_window(spark):
    faults = [{"sequence": 2, "kind": "drop", "seconds": None}, {"sequence": 4, "kind": "delay", "seconds": 2.5}, {"sequence": 6, "kind": "duplicate", "seconds": None}]
    rows = [scenario(incidents=faults, consumer_seconds=c) | {"session": f"s{c}"} for c in (0.0, 1.4, 3.0)]
    df = spark.createDataFrame([(r["session"], r["entries"], r["incidents"], r["consumer_seconds"]) for r in rows], "session string, entries array<struct<source_offset_samples:bigint>>, incidents array<struct<sequence:bigint,kind:string,seconds:double>>, consumer_seconds double")
    got = replay.replay(df).toPandas()
    for _, g in got.groupby("session"):
        assert sorted(g[g["event"].isin(["received", "lost"])]["seq"]) == list(range(8))
        assert g.sort_values("step")["at"].is_monotonic_increasing and (g["event"] == "duplicate").sum() == 1
    assert list(got[(got.session == "s0.0") & (got.event == "received")].sort_values("step")["seq"]) == [0, 1, 3, 5, 6, 4, 7]


def play(*commands):
    s = dict(zip(incidents.FIELDS, incidents.START, strict=True))
    return [(at, e) for c in commands for at, e, _ in incidents.step(s, *c)], s


def test_incidents():
    told, s = play((0, "start"), (5, "start"), (29.9, "tick"), (30.5, "tick"), (31, "tick"), (32, "delivered", True), (33, "retry"), (40, "resolve"))
    assert told == [(0, "anomaly_started"), (30.0, "persistence_confirmed"), (30.5, "dispatch"), (32, "alert_sent"), (40, "resolved")] and s["attempts"] == 1
    told, s = play((0, "start"), (30, "tick"), (31, "delivered", False), (32, "tick"), (33, "retry"), (34, "tick"), (35, "delivered", True))
    assert [e for _, e in told][3:] == ["alert_failed", "retry_requested", "dispatch", "alert_sent"] and s["attempts"] == 2
    for unknown in ((31, "restart"), (31, "delivered", None)):
        told, s = play((0, "start"), (30, "tick"), unknown, (32, "retry"), (33, "tick"))
        assert told[-1][1] == "alert_failed" and s["delivery"] == "unknown"
    told, _ = play((0, "start"), (30, "tick"), (31, "resolve"), (32, "delivered", True))
    assert told[-2:] == [(32, "alert_sent"), (31, "resolved")]
    assert play((0, "start"), (10, "resolve"), (40, "tick"))[0] == [(0, "anomaly_started"), (10, "resolved")]


def test_incident_stream_survives_restarts_and_equals_the_batch(spark, tmp_path):
    commands = [("s", float(t), k, ok, None) for t, k, ok in ((0, "start", None), (30, "tick", None), (31, "delivered", False), (33, "retry", None), (34, "tick", None), (35, "delivered", True), (50, "resolve", None))]
    for part in (commands[:3], commands[3:]):
        spark.createDataFrame(part, incidents.COMMANDS).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = incidents.incident_stream(spark.readStream.schema(incidents.COMMANDS).json(f"{tmp_path}/in"))
        q = sinks.log_stream(stream, f"{tmp_path}/out", f"{tmp_path}/mark").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.schema(incidents.EVENTS).json(f"{tmp_path}/out")
    want = incidents.incident_log(spark.createDataFrame(commands, incidents.COMMANDS))
    assert got.count() == 8 and got.exceptAll(want).isEmpty()
    h = incidents.history(want).collect()
    assert len(h) == 1 and h[0]["attempts"] == 2 and len(h[0]["events"]) == 8


def best(q, r):
    found = [np.corrcoef(q, r[k : k + len(q)])[0, 1] if np.ptp(r[k : k + len(q)]) else 0 for k in range(len(r) - len(q) + 1)]
    k = int(np.abs(found).argmax())
    return k, found[k]


def test_sliding_overlap(spark):
    rng = np.random.default_rng(1)
    record, island = rng.normal(size=300), np.zeros(60)
    island[30:36] = rng.normal(size=6)
    copy = -1.6 * record[100:140] - 0.17
    queries = {"copy": copy, "other": rng.normal(size=17), "flat": np.ones(5), "long": rng.normal(size=301)}
    records = {"r": record, "island": island, "flat": np.zeros(50)}
    make = lambda d, name: spark.createDataFrame([(k, v.tolist()) for k, v in d.items()], f"{name} string, samples array<double>")
    rows = {(r["query"], r["record"]): r for r in overlap.sliding_overlap(make(queries, "query"), make(records, "record")).collect()}
    assert len(rows) == 12
    assert rows["copy", "r"]["offset"] == 100 and rows["copy", "r"]["correlation"] == pytest.approx(-1)
    for name, r in (("other", record), ("other", island)):
        k, c = best(queries[name], r)
        got = rows[name, "r" if r is record else "island"]
        assert got["offset"] == k and got["correlation"] == pytest.approx(c)
    assert rows["flat", "r"]["reason"] == "constant_query" and rows["copy", "flat"]["reason"] == "no_stable_variance_window" and rows["long", "r"]["reason"] == "length"
    top = {r["query"]: r["record"] for r in overlap.best_records(spark.createDataFrame(list(rows.values()), overlap.RESULT)).collect()}
    assert top["copy"] == "r" and set(top) == {"copy", "other"}


def test_near_pairs_of_many_blocks(spark):
    x = np.random.default_rng(2).normal(size=(70, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if u[i] @ u[j] > 0.7}
    assert {(r["a"], r["b"]) for r in overlap.near_pairs(df, 0.7, block=8).collect()} == want


def test_stress_and_series(spark):
    x = np.random.default_rng(3).normal(size=8000)
    df = spark.createDataFrame([("a", x.tolist()), ("b", x.tolist()), ("c", None), ("d", x[:77].tolist())], "id string, x array<double>")
    rows = df.select("id", "x", *[f(F.col("x"), F.col("id")).alias(n) for n, f in stress.CHANGES.items()]).cache()
    got = {r["id"]: r for r in rows.collect()}
    assert got["a"]["T2"] != got["b"]["T2"] and got["c"]["T2"] is None and got["d"]["T2"] is None and got["d"]["T1"] == x[:77][::-1].tolist()
    blocks = lambda v: sorted(map(tuple, np.reshape(v, (-1, 250))))
    assert blocks(got["a"]["T2"]) == blocks(x) and got["a"]["T2"] != x.tolist()
    assert np.allclose(np.abs(np.fft.rfft(got["a"]["T3"])), np.abs(np.fft.rfft(x)))
    inv = {r["id"]: r["i"] for r in rows.select("id", stress.invariants("x", "T3").alias("i")).collect()}
    assert inv["a"]["magnitude_distance"] < 1e-9 and inv["a"]["sample_distance"] > 0.5 and not inv["a"]["same_values"] and inv["c"]["rms_change"] is None
    tone = np.sin(2 * np.pi * 1500 * np.arange(8000) / 8000)
    s = spark.createDataFrame([(tone.tolist(),)], "x array<double>").withColumn("s", series.band_series()("x"))
    r = s.select("s", series.target_text(F.lit("leak"), F.col("s")).alias("t")).first()
    assert (len(r["s"]), len(r["s"][0]), r["s"][1][61:]) == (4, 64, [0.0] * 3) and r["t"] == "leak; Greatest mean spectral energy: 1000-2000 Hz."
    energy = np.expm1(np.array(r["s"])[:, :61]).sum(axis=0)
    frame = np.lib.stride_tricks.sliding_window_view(tone * math.sqrt(2), 256)[::128] * np.hanning(256)
    assert np.allclose(energy, (frame**2).sum(axis=1) / (np.hanning(256) ** 2).sum(), rtol=1e-3)


def test_displays(spark):
    one = spark.range(1)
    r = one.select(
        display.clock_text(F.lit(75.25)).alias("c"), display.clock_text(F.lit(-3.0)).alias("n"), display.loop_time(F.lit(-1.0), F.lit(4.0)).alias("l"),
        display.polyline(F.lit("M 10 20 H 30 V -5.5")).alias("p"), display.nearest_on_segment(F.lit(5.0), F.lit(5.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("s"),
        display.status(F.lit(1), F.lit(True)).alias("h"), display.status(F.lit(2), F.lit(True)).alias("y"), display.status(F.lit(2), F.lit(False)).alias("o"),
    ).first()
    assert (r["c"], r["n"], r["l"]) == ("01:15.3", "00:00.0", 3.0)
    assert [tuple(p) for p in r["p"]] == [(10.0, 20.0), (30.0, 20.0), (30.0, -5.5)]
    assert r["s"]["distance"] == pytest.approx(50**0.5) and (r["h"], r["y"], r["o"]) == ("healthy", "confirmed", "under observation")
    cases = [(0, [0.0, 1.0], [[0.0, -20.0], [0.0, -20.0]], [0.0, 1.0]), (1, [0.0, 1.0], [[0.0], [0.0, 1.0]], [0.0, 1.0]), (2, [], [], []), (3, [0.0], [[float("nan")]], [0.0]), (4, None, None, None), (5, [5.0], [[-200.0] * 100], [float(i) for i in range(100)])]
    df = spark.createDataFrame(cases, "id int, frequencies array<double>, matrix array<array<double>>, times array<double>")
    got = {}
    for x in display.rings(df, "id").orderBy("id", "time").collect():
        got.setdefault(x["id"], []).append(x)
    assert {k: len(v) for k, v in got.items()} == {0: 2, 5: 50} and got[0][0]["energy_db"] == pytest.approx(0) and got[0][0]["centroid_hz"] == pytest.approx(0.5)
    assert got[0][1]["bands_db"] == pytest.approx([-20, -120, -20]) and got[5][1]["time"] == 2.0 and (got[5][1]["centroid_hz"], got[5][1]["radius"]) == (0.0, pytest.approx(0.18))


def test_narration(spark):
    row = lambda p: [0.0] * 9 + [p]
    cases = [([row(0.9)], None), ([row(0.5)] * 65, "length"), ([], "length"), ([[0.0] * 9], "width"), ([row(float("nan"))], "not_finite"), ([row(2.0)], "score"), (None, "length")]
    df = spark.createDataFrame([(h,) for h, _ in cases], "h array<array<double>>")
    assert [r[0] for r in df.select(narration.history_problem(F.col("h"))).collect()] == [c for _, c in cases]
    h = spark.createDataFrame([([row(0.9), row(0.1)],)], "h array<array<double>>").select(narration.padded(F.col("h"), [0.0] * 10, [1.0] * 9 + [0.01]).alias("h")).first()["h"]
    assert len(h) == 64 and h[61] == [0.0] * 10 and h[62][9] == 10.0 and h[63][9] == pytest.approx(10.0)
    texts = {"leak; Greatest mean spectral energy: 0-1000 Hz.": ("leak", None), "leak": (None, "grammar"), "maybe; Greatest mean spectral energy: 0-1000 Hz.": (None, "grammar")}
    a = spark.createDataFrame([(t,) for t in texts], "t string").select(narration.answer(F.col("t")).alias("a")).collect()
    assert [(r["a"]["label"], r["a"]["problem"]) for r in a] == list(texts.values())


def test_controls_and_choice(spark):
    rng = np.random.default_rng(4)
    y = np.arange(60) % 2
    pdf = pd.DataFrame({"clip_id": [f"c{i}" for i in range(60)], "group_id": [f"g{i // 2 * 2 + i % 2}" for i in range(60)], "y": y, "a": y + rng.normal(0, 0.7, 60), "flat": 1.0})
    df = spark.createDataFrame(pdf)
    model = resampling.fit_logistic(df, ["a", "flat"], 2.0)
    z = (pdf["a"] - pdf["a"].mean()) / pdf["a"].std(ddof=0)
    w, b = model["weights"]["a"], model["intercept"]
    p = 1 / (1 + np.exp(-(w * z + b)))
    assert abs(((p - y) * z).sum() + w / 2.0) < 1e-3 and abs((p - y).sum()) < 1e-3 and model["weights"]["flat"] == pytest.approx(0, abs=1e-6)
    held = resampling.out_of_fold(df, ["a"], 3).cache()
    assert held.count() == 60 and held.filter("p is null").isEmpty() and metrics.roc_auc(held).first()[0] > 0.7
    c = spark.createDataFrame([("x", 0.5, 2), ("y", 0.9, 3), ("z", 0.9, 1), ("w", None, 0)], "name string, score double, epoch int")
    assert resampling.choose(c, "score", "epoch").first()["name"] == "z"
    s = spark.createDataFrame([("c", 0, [1.0], [1.0]), ("c", 1, [1.0, 2.0], [1.0, 2.5]), ("c", 2, [1.0], [9.0]), ("d", 0, [1.0], [1.0])], "clip_id string, stage int, a array<double>, b array<double>")
    assert [tuple(r) for r in resampling.first_divergence(s).collect()] == [("c", 1, 0.5)]
    assert [r[0] for r in spark.createDataFrame([(0.1, 0.01), (0.1, -0.01), (0.001, 0.01), (0.1, None)], "g double, l double").select(resampling.promoted(F.col("g"), F.col("l"), 0.02)).collect()] == [True, False, False, False]
