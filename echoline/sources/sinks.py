"""Writing results so that a reader can check them: runs of scores, skeletons, logs and receipts of stages."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.sources.manifests import ManifestError, file_digests

#: What a run's metadata must say.
METADATA = ("run_id", "model_name", "checkpoint", "training_commit", "split_filename", "split_sha256", "timestamp", "threshold_rule", "test_labels_not_used_for_tuning")


def checked_metadata(metadata: dict, split_filename: str | None = None, split_sha256: str | None = None) -> dict:
    """``metadata`` if all fields are there, the test labels were not used and the split is the one named."""
    missing = [f for f in METADATA if metadata.get(f) in (None, "")]
    if missing:
        raise ManifestError("metadata lacks " + ", ".join(missing))
    if metadata["test_labels_not_used_for_tuning"] is not True:
        raise ManifestError("test labels were used for tuning")
    for field, wanted in (("split_filename", split_filename), ("split_sha256", split_sha256)):
        if wanted is not None and metadata[field] != wanted:
            raise ManifestError(f"{field} is not {wanted}")
    return metadata


def _json_once(spark: SparkSession, path: str, value: dict) -> None:
    """One JSON document in a new folder; NaN and infinities are refused."""
    spark.createDataFrame([(json.dumps(value, allow_nan=False, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def write_run(scores: DataFrame, path: str, metadata: dict, exact: bool = False) -> None:
    """Write (clip_id, p) as ``path``/predictions, CSV in the order of clip_id, then ``path``/metadata.

    Scores have 10 decimals, or with ``exact`` the shortest text that reads back as the same double. Ids must be unique
    and scores lie in [0, 1]; existing folders are never overwritten. Files keep the order: each holds a range of ids.
    """
    checked_metadata(metadata)
    p = F.col("p").cast("double")
    bad = scores.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(p.isNull() | F.isnan(p) | ~p.between(0, 1)).alias("wrong")).filter("n > 1 or wrong > 0 or clip_id is null")
    if not bad.isEmpty():
        raise ManifestError("ids are repeated or scores are not in [0, 1]")
    text = p.cast("string") if exact else F.format_string("%.10f", p)
    scores.select("clip_id", text.alias("probability")).orderBy("clip_id").write.mode("errorifexists").option("header", True).csv(f"{path}/predictions")
    _json_once(scores.sparkSession, f"{path}/metadata", metadata)


def read_run(spark: SparkSession, path: str, split_filename: str | None = None, split_sha256: str | None = None) -> tuple[DataFrame, dict]:
    """(clip_id, p) and metadata of a run; the metadata comes last, so a run without it was not finished."""
    metadata = json.loads(spark.read.text(f"{path}/metadata", wholetext=True).first()[0])
    rows = spark.read.schema("clip_id string, p double").options(header=True, mode="FAILFAST").csv(f"{path}/predictions")
    return rows, checked_metadata(metadata, split_filename, split_sha256)


def _fs(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def publish(parts: dict[str, DataFrame], path: str, **facts) -> None:
    """Write named tables, then a receipt of all their files, beside ``path``, and move the whole there at the end.

    Readers see all or nothing: a run that is cut short leaves only its staging folder, which a later run doesn't read. An existing ``path`` is refused,
    also if another run finished meanwhile: a rename onto a folder would put one into the other, so the target is looked at last.
    """
    spark = next(iter(parts.values())).sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise ManifestError(f"{path} exists")
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    for name, rows in parts.items():
        rows.write.parquet(f"{staging}/{name}")
    rows = None
    for name in parts:
        own = file_digests(spark, f"{staging}/{name}").select(F.concat(F.lit(f"{name}/"), F.element_at(F.split("path", "/"), -1)).alias("file"), "bytes", "sha256")
        rows = own if rows is None else rows.unionByName(own)
    rows.withColumn("facts", F.lit(json.dumps(facts, allow_nan=False, sort_keys=True))).write.parquet(f"{staging}/receipt")
    if fs.exists(target) or not fs.rename(_fs(spark, staging)[1], target):
        raise ManifestError(f"{path} exists or can't be made")


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of a published folder, once its files are those of the receipt."""
    known = spark.read.parquet(f"{path}/receipt").filter(F.col("file").startswith(f"{name}/")).select("file", "bytes", "sha256")
    now = file_digests(spark, f"{path}/{name}").select(F.concat(F.lit(f"{name}/"), F.element_at(F.split("path", "/"), -1)).alias("file"), "bytes", "sha256")
    if known.isEmpty() or not known.exceptAll(now).isEmpty() or not now.exceptAll(known).isEmpty():
        raise ManifestError(f"{name} is not what the receipt says")
    return spark.read.parquet(f"{path}/{name}")


def write_drop(files: DataFrame, path: str, receipt: dict[str, str]) -> None:
    """Write a result drop (name, content text) with its receipt: the given fields and the SHA-256 of each other file, in one table.

    A file ``metrics.json`` gives the field ``metrics_sha256``, and so on; names must be unique and none may be the receipt's.
    """
    hashes = {r["name"]: r["h"] for r in files.select("name", F.sha2(F.col("content").cast("binary"), 256).alias("h")).collect()}
    if len(hashes) != files.count() or "receipt.json" in hashes or any(not n.endswith(".json") for n in hashes):
        raise ManifestError("a drop has unique JSON files beside its receipt")
    said = json.dumps({**receipt, **{f"{n[:-5]}_sha256": h for n, h in hashes.items()}}, sort_keys=True)
    own = files.sparkSession.createDataFrame([("receipt.json", said)], "name string, content string")
    files.select("name", "content").unionByName(own).coalesce(1).write.mode("errorifexists").parquet(path)


def read_drop(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of a drop whose files have the hashes of its receipt; else a refusal that names the file."""
    files = spark.read.parquet(path)
    said = F.from_json(F.max(F.when(F.col("name") == "receipt.json", F.col("content"))), "map<string,string>")
    both = files.filter("name <> 'receipt.json'").crossJoin(F.broadcast(files.agg(said.alias("r"))))  # one row
    found = both.select("name", F.element_at("r", F.concat(F.regexp_replace("name", r"\.json$", ""), F.lit("_sha256"))).eqNullSafe(F.sha2(F.col("content").cast("binary"), 256)).alias("ok"))
    bad = sorted(r["name"] for r in found.filter("not ok").collect())
    if bad or files.filter("name = 'receipt.json'").count() != 1:
        raise ManifestError("not what the receipt says: " + (", ".join(bad) or "receipt.json"))
    return files


def write_skeleton(split: DataFrame, folds: list[str], path: str) -> None:
    """Ids of the folds with an empty score, to be filled in."""
    rows = split.filter(F.col("fold").isin(*folds)).select("clip_id", F.lit(None).cast("string").alias("probability"))
    rows.orderBy("clip_id").write.mode("errorifexists").option("header", True).csv(path)


def write_receipt(spark: SparkSession, artifacts: str, path: str, **facts) -> None:
    """Record the digests of all files under ``artifacts`` as a table; facts go into every row as JSON."""
    rows = file_digests(spark, artifacts).withColumn("facts", F.lit(json.dumps(facts, allow_nan=False, sort_keys=True)))
    rows.write.mode("errorifexists").parquet(path)


def receipt_holds(spark: SparkSession, artifacts: str, path: str, **facts) -> bool:
    """Whether the files are still those of the receipt, and the facts the same; then the stage need not run again."""
    known = spark.read.parquet(path)
    now = file_digests(spark, artifacts).withColumn("facts", F.lit(json.dumps(facts, allow_nan=False, sort_keys=True)))
    return known.exceptAll(now).isEmpty() and now.exceptAll(known).isEmpty()


def log_stream(rows: DataFrame, path: str, checkpoint: str):
    """Append a stream's rows to JSON lines, exactly once per checkpoint."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
