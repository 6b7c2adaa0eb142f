"""Tables that declare what a study holds: strict CSV, frozen manifests, recording grids, scenarios, inventories."""

from __future__ import annotations

import io
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Samples per recording and window, and the codes of the recording grid.
RECORDING_SAMPLES, WINDOW_SAMPLES, SAMPLE_RATE = 240000, 8000, 8000
TOPOLOGIES = ("BR", "LO")
TYPES = ("CC", "GL", "LC", "NL", "OL")
CONDITIONS = ("0.18 LPS_N", "0.47 LPS_N", "ND_NN", "ND_N", "Transient_NN", "Transient_N")
SENSORS = ("H1", "H2")
QUIET_TYPE = "NL"

SCENARIO = (
    "schema_version int, device_id string, source_mode string, consumer_seconds double,"
    "entries array<struct<path:string,audio_sha256:string,provenance:string,source_offset_samples:bigint>>,"
    "incidents array<struct<sequence:bigint,kind:string,seconds:double>>"
)
#: Provenances a source mode may have, and the kinds of incidents.
PROVENANCES = {"development_fixture": ("synthetic",), "replay": ("train", "authorized_demo")}
KINDS = ("drop", "delay", "duplicate")


class ManifestError(ValueError):
    """A declared table is not what it says."""


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    return first[0][0].lstrip("\ufeff").split(",") if first else []


def strict_csv(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """A CSV file whose header is exactly the schema's columns in order; malformed rows fail the read.

    ``key``, if given, must be unique and not null.
    """
    fields = StructType.fromDDL(schema)
    names = _header(spark, path)
    if names != fields.names:
        raise ManifestError(f"header {names} is not {fields.names}")
    rows = spark.read.schema(fields).options(header=True, enforceSchema=False, mode="FAILFAST").csv(path)
    if key and not rows.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1)).isEmpty():
        raise ManifestError(f"{key} is not unique")
    return rows


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def frozen_csv(spark: SparkSession, path: str, schema: str, key: str, sha256: str) -> DataFrame:
    """``strict_csv`` of a file whose bytes have the declared SHA-256."""
    found = [r["sha256"] for r in file_digests(spark, path).select("sha256").collect()]
    if found != [sha256]:
        raise ManifestError("the file is not the frozen one")
    return strict_csv(spark, path, schema, key)


def audit_paths(spark: SparkSession, path: str, key: str = "clip_id", value: str = "path") -> DataFrame:
    """(key, value) of an audit file that has many columns: only these two are parsed, so none of the others can surface.

    The file must have both; keys are unique and, like the values, not null.
    """
    names = _header(spark, path)
    if names.count(key) != 1 or names.count(value) != 1:
        raise ManifestError(f"the file lacks {key} or {value}, or has it twice")
    whole = StructType.fromDDL(", ".join(f"`{n}` string" for n in names))
    rows = spark.read.schema(whole).options(header=True, enforceSchema=False, mode="FAILFAST").csv(path).select(key, value)
    if not rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("given")).filter(F.col(key).isNull() | (F.col("n") > 1) | (F.col("given") == 0)).isEmpty():
        raise ManifestError(f"{key} is not unique, or a row lacks it or its {value}")
    return rows


def split_checks(split: DataFrame) -> DataFrame:
    """(name, passed, coverage, failures) of a split (clip_id, label, group_id, fold): ids, values and whole groups."""
    from echoline.operators.audit import check, crossing

    pure = split.groupBy("group_id").agg(F.countDistinct("label").alias("labels"))
    parts = [
        check(split.groupBy("clip_id").count(), "unique_clip", F.col("count") > 1),
        check(split, "known_fold", F.col("fold").isNull() | ~F.col("fold").isin("train", "validation", "test")),
        check(split, "known_label", F.col("label").isNull() | ~F.col("label").isin("leak", "no_leak")),
        crossing(split, "group_id", "group_in_one_fold"),
        check(pure, "group_of_one_label", F.col("labels") > 1),
    ]
    return reduce(DataFrame.unionByName, parts)


def safe_path(path: Column) -> Column:
    """Whether a relative path stays inside its root: no empty name, no ``..``, drive, backslash or leading slash."""
    parts = F.split(path, "/")
    return path.isNotNull() & ~path.rlike(r"[\\\\:\x00]") & F.forall(parts, lambda p: (p != "") & (p != ".") & (p != ".."))


def stable_id(kind: str, *parts: Column) -> Column:
    """``kind`` and the SHA-256 of kind and parts, separated by zero characters."""
    return F.concat(F.lit(f"{kind}_"), F.sha2(F.concat_ws("\x00", F.lit(kind), *[p.cast("string") for p in parts]), 256))


def recording_grid(spark: SparkSession) -> DataFrame:
    """The 120 declared recordings and 2 of background noise, from one row that is exploded along the fixed codes."""
    grid = spark.range(1)
    for name, codes in (("topology", TOPOLOGIES), ("leak_type", TYPES), ("condition", CONDITIONS), ("sensor", SENSORS)):
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, codes))))
    grid = grid.drop("id").withColumn("condition_key", F.concat_ws("_", "topology", "leak_type", "condition"))
    grid = grid.withColumn("label", F.when(F.col("leak_type") == QUIET_TYPE, "no_leak").otherwise("leak")).withColumn("subset", F.lit("primary"))
    noise = spark.range(1).select(F.explode(F.array(*map(F.lit, SENSORS))).alias("sensor"), F.lit("background_noise").alias("condition_key"), F.lit("environmental_noise").alias("label"), F.lit("background").alias("subset"))
    return grid.unionByName(noise, allowMissingColumns=True).withColumn("recording_id", stable_id("recording", F.col("condition_key"), F.col("sensor")))


def window_table(recordings: DataFrame, samples: int = RECORDING_SAMPLES, width: int = WINDOW_SAMPLES) -> DataFrame:
    """One row per whole window of each recording: clip_id, start_sample, n_samples, sample_rate and the recording's columns."""
    start = F.explode(F.sequence(F.lit(0), F.lit(samples - width), F.lit(width)).cast("array<bigint>"))
    rows = recordings.withColumn("start_sample", start).withColumns({"n_samples": F.lit(width).cast("long"), "sample_rate": F.lit(SAMPLE_RATE).cast("long")})
    return rows.withColumn("clip_id", stable_id("clip", F.col("recording_id"), F.col("start_sample"), F.col("n_samples")))


def coverage_gaps(clips: DataFrame, samples: int = RECORDING_SAMPLES, width: int = WINDOW_SAMPLES) -> DataFrame:
    """Recordings (recording_id, start_sample) whose starts are not exactly every whole window, once each."""
    wanted = F.sequence(F.lit(0), F.lit(samples - width), F.lit(width)).cast("array<bigint>")
    starts = clips.groupBy("recording_id").agg(F.sort_array(F.collect_list("start_sample")).alias("starts"))
    return starts.filter(~F.col("starts").eqNullSafe(wanted))


def inventory_difference(found: DataFrame, declared: DataFrame, key: str = "path") -> DataFrame:
    """(key, side): what is only found or only declared."""
    return found.select(key).exceptAll(declared.select(key)).withColumn("side", F.lit("found")).unionByName(declared.select(key).exceptAll(found.select(key)).withColumn("side", F.lit("declared")))


def zip_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, bytes, crc, safe) of the members of the ZIP files under ``path``; only directories are read."""
    @F.pandas_udf("array<struct<member:string,bytes:bigint,crc:bigint>>")
    def members(content: pd.Series) -> pd.Series:
        return pd.Series([[(i.filename, i.file_size, i.CRC) for i in zipfile.ZipFile(io.BytesIO(c)).infolist() if not i.is_dir()] for c in content])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    rows = files.select(F.col("path").alias("archive"), F.explode(members("content")).alias("m")).select("archive", "m.*")
    return rows.withColumn("safe", safe_path(F.col("member")))


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Replay scenarios, one JSON document per file, with ``file`` and ``problem`` (null if the scenario is sound)."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", SCENARIO).alias("s"))
    rows = raw.select("file", "s.*")
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c != float("inf"))
    e, i = F.col("entries"), F.coalesce("incidents", F.array())
    offsets = F.transform(e, lambda x: x["source_offset_samples"])
    apart = F.forall(F.sequence(F.lit(0), F.size(e) - 1), lambda k: F.when(k == 0, F.get(offsets, k) >= 0).otherwise(F.get(offsets, k) >= F.get(offsets, k - 1) + WINDOW_SAMPLES))
    allowed = F.coalesce(*[F.when(F.col("source_mode") == m, F.array(*map(F.lit, names))) for m, names in PROVENANCES.items()])
    steps = [
        ("schema_version", F.col("schema_version") == 1),
        ("device_id", F.length("device_id").between(1, 128)),
        ("source_mode", F.col("source_mode").isin(*PROVENANCES)),
        ("entries", F.size(e) > 0),
        ("offsets", apart),
        ("provenance", F.forall(e, lambda x: F.array_contains(allowed, x["provenance"]))),
        ("path", F.forall(e, lambda x: F.length(x["path"]) > 0)),
        ("digest", F.forall(e, lambda x: x["audio_sha256"].rlike("^[0-9a-f]{64}$"))),
        ("incident_sequence", F.forall(i, lambda x: x["sequence"].between(0, F.size(e) - 1)) & (F.size(F.array_distinct(F.transform(i, lambda x: x["sequence"]))) == F.size(i))),
        ("incident_kind", F.forall(i, lambda x: x["kind"].isin(*KINDS))),
        ("delay", F.forall(i, lambda x: (x["kind"] != "delay") | number(x["seconds"]))),
        ("consumer_seconds", number(F.coalesce("consumer_seconds", F.lit(0.0)))),
    ]
    return rows.withColumn("problem", F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in steps]))
