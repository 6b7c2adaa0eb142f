"""Audit scans, originals, staged folders, drops and frozen models: what is refused, and what a cut-short run leaves."""

import glob
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from echoline.operators import audit, resampling
from echoline.sources import manifests, models, sinks, wav
from echoline.sources.manifests import ManifestError


def test_an_audit_scan_reads_two_columns(spark, tmp_path):
    (tmp_path / "audit.csv").write_text("clip_id,label,path,session_id\na,leak,x/a.wav,s1\nb,no_leak,x/b.wav,s2\n")
    rows = manifests.audit_paths(spark, f"file://{tmp_path}/audit.csv")
    assert rows.columns == ["clip_id", "path"] and {tuple(r) for r in rows.collect()} == {("a", "x/a.wav"), ("b", "x/b.wav")}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<clip_id:string,path:string>" in plan and "session_id" not in plan
    for text in ("clip_id,label\na,x\n", "clip_id,path\na,x\na,y\n", "clip_id,path\na,\n", "clip_id,path,path\na,x,y\n"):
        (tmp_path / "bad.csv").write_text(text)
        with pytest.raises(ManifestError):
            manifests.audit_paths(spark, f"file://{tmp_path}/bad.csv")


def test_originals_are_one_set(spark):
    split = spark.createDataFrame([("a",), ("b",), ("c",), ("e",)], "clip_id string")
    md5 = lambda x: hashlib.md5(x).hexdigest()
    paths = spark.createDataFrame([("a", "pa", md5(b"1")), ("b", "pb", md5(b"2")), ("c", "pc", md5(b"3")), ("d", "pd", md5(b"4"))], "clip_id string, path string, digest string")
    files = spark.createDataFrame([("pa", bytearray(b"1")), ("pb", bytearray(b"changed")), ("pd", bytearray(b"4"))], "path string, content binary")
    got = {r["name"]: r["failures"] for r in audit.originals(split, paths, files).collect()}
    assert got == {"every clip has its path": 1, "no path without a clip": 1, "one path for a clip": 0, "every path has its file": 1, "files byte for byte": 1}
    whole = audit.originals(split.filter("clip_id = 'a'"), paths.filter("clip_id = 'a'"), files)
    audit.enforce(whole)
    sha = audit.originals(split.filter("clip_id = 'a'"), paths.filter("clip_id = 'a'"), files, F.sha2("content", 256))
    with pytest.raises(ValueError, match="byte for byte"):
        audit.enforce(sha)


def test_a_folder_appears_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path, rows = f"{tmp_path}/out", spark.range(5).withColumnRenamed("id", "n")
    with monkeypatch.context() as m:
        m.setattr(sinks, "file_digests", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            sinks.publish({"rows": rows}, f"file://{path}", stage="one")
    assert not glob.glob(path) and glob.glob(f"{path}.staging-*")
    sinks.publish({"rows": rows, "more": rows.limit(2)}, f"file://{path}", stage="one")
    assert sinks.published(spark, f"file://{path}", "rows").count() == 5 and sinks.published(spark, f"file://{path}", "more").count() == 2
    assert json.loads(spark.read.parquet(f"file://{path}/receipt").first()["facts"]) == {"stage": "one"}
    with pytest.raises(ManifestError, match="exists"):
        sinks.publish({"rows": rows}, f"file://{path}")
    rows.limit(1).write.mode("append").parquet(f"file://{path}/more")
    with pytest.raises(ManifestError, match="more is not"):
        sinks.published(spark, f"file://{path}", "more")
    with pytest.raises(ManifestError):
        sinks.published(spark, f"file://{path}", "receipt")


def test_a_drop_has_the_hashes_of_its_files(spark, tmp_path):
    files = spark.createDataFrame([("metrics.json", "{}"), ("comparison.json", '{"a":1}')], "name string, content string")
    sinks.write_drop(files, f"file://{tmp_path}/drop", {"status": "OFFICIAL"})
    got = {r["name"]: r["content"] for r in sinks.read_drop(spark, f"file://{tmp_path}/drop").collect()}
    receipt = json.loads(got["receipt.json"])
    assert receipt == {"status": "OFFICIAL", "metrics_sha256": hashlib.sha256(b"{}").hexdigest(), "comparison_sha256": hashlib.sha256(b'{"a":1}').hexdigest()}
    changed = spark.createDataFrame([(n, c + " " if n == "metrics.json" else c) for n, c in got.items()], files.schema)
    changed.write.parquet(f"file://{tmp_path}/changed")
    with pytest.raises(ManifestError, match="metrics.json"):
        sinks.read_drop(spark, f"file://{tmp_path}/changed")
    files.write.parquet(f"file://{tmp_path}/bare")
    with pytest.raises(ManifestError):
        sinks.read_drop(spark, f"file://{tmp_path}/bare")
    for bad in ([("a.txt", "")], [("receipt.json", "{}")], [("a.json", ""), ("a.json", "")]):
        with pytest.raises(ManifestError):
            sinks.write_drop(spark.createDataFrame(bad, files.schema), f"file://{tmp_path}/never", {})


def test_a_model_is_read_as_it_was_frozen(spark, tmp_path):
    import random

    rng = random.Random(1)
    rows = spark.createDataFrame([(i, float(y), rng.gauss(y, 1), rng.gauss(0, 2)) for i in range(80) for y in [i % 2]], "clip_id int, y double, a double, b double")
    model, recipe = resampling.fit_logistic(rows, ["a", "b"], 0.5), {"c": 0.5, "version": "v1"}
    sha = models.save(spark, model, recipe, f"file://{tmp_path}/m")
    assert models.load(spark, f"file://{tmp_path}/m", sha, recipe) == model
    for expected, own, why in (("0" * 64, recipe, "digest"), (sha, {"c": 1.0, "version": "v1"}, "recipe")):
        with pytest.raises(ManifestError, match=why):
            models.load(spark, f"file://{tmp_path}/m", expected, own)
    kept = spark.read.parquet(f"file://{tmp_path}/m")
    kept.withColumn("weight", F.when(F.col("place") == 0, F.col("weight") + 1e-15).otherwise(F.col("weight"))).write.parquet(f"file://{tmp_path}/bent")
    kept.filter("place = 1").write.parquet(f"file://{tmp_path}/half")
    for name, why in (("bent", "digest"), ("half", "whole")):
        with pytest.raises(ManifestError, match=why):
            models.load(spark, f"file://{tmp_path}/{name}", sha, recipe)


def test_a_decoder_has_a_policy():
    from tests.test_streams_and_sources import wav_bytes

    import numpy as np

    x = (np.sin(np.arange(8000)) * 9000).astype("<i2")
    narrow, wide = wav_bytes(x), wav_bytes(x.astype("<i4") << 16)
    assert wav.decoded(narrow, 8000, 8000, "strict")[1] is None and wav.decoded(wide, 8000, 8000, "strict")[1] == "sample_width" and wav.decoded(wide, 8000, 8000)[1] is None
    with pytest.raises(ValueError):
        wav.decode(policy="loose")
