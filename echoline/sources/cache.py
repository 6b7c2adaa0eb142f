"""A versioned cache by fold: a fold is rebuilt when its input or the version changed, read only when both are known, and held against a recomputation.

Layout: ``data`` and ``receipts`` under one folder, both cut by fold. Receipts are written last and name the version, the digest of the input and that
of what was stored, so a fold that was cut short has no valid receipt. Digests don't depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoline.operators.audit import check
from echoline.sources.manifests import ManifestError

RECEIPT = "fold string, version string, input string, stored string, rows long"
#: Folds that a development cache may hold.
DEVELOPMENT = ("train", "validation")


def content_digest(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., rows, digest): one digest of each group's rows, the same in any order and partitioning; repeated rows count.

    Each row's SHA-256 over its columns by name is cut into four 64-bit numbers, which add up in exact decimals: sums combine before the shuffle.
    """
    names = sorted(set(rows.columns) - set(by))
    one = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    word = lambda i: F.conv(F.substring("__h", 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")
    sums = rows.withColumn("__h", one).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(word(i)).alias(f"__{i}") for i in range(4)])
    return sums.select(*by, "rows", F.sha2(F.concat_ws(":", "rows", *[f"__{i}" for i in range(4)]), 256).alias("digest"))


def receipts(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(RECEIPT).parquet(f"{path}/receipts")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECEIPT)


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fold").parquet(path)


def refresh(inputs: DataFrame, path: str, version: str, build: Callable[[DataFrame], DataFrame], key: str = "clip_id") -> list[str]:
    """Bring the cache of ``inputs`` (key, fold, ...) up to ``version`` and give back the folds that were rebuilt, in order.

    ``build`` makes the stored rows, with ``key`` and ``fold``, from rows of the input. Folds are a handful of names.
    """
    spark = inputs.sparkSession
    if not inputs.filter(F.col("fold").isNull() | F.col(key).isNull()).isEmpty():
        raise ManifestError("a row lacks its fold or its id")
    now = content_digest(inputs, ["fold"]).select("fold", F.col("digest").alias("now"))
    known = receipts(spark, path)
    old = now.join(known, "fold", "left").filter(~F.coalesce((F.col("version") == version) & (F.col("input") == F.col("now")), F.lit(False)))
    digests = {r["fold"]: r["now"] for r in old.collect()}
    stale = sorted(digests)
    if stale:
        _write(build(inputs.filter(F.col("fold").isin(stale))).withColumn("version", F.lit(version)), f"{path}/data")
        kept = content_digest(stored(spark, path).filter(F.col("fold").isin(stale)), ["fold"])
        given = F.create_map(*[F.lit(x) for kv in digests.items() for x in kv])
        _write(kept.select("fold", F.lit(version).alias("version"), given[F.col("fold")].alias("input"), F.col("digest").alias("stored"), "rows"), f"{path}/receipts")
    return stale


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data").withColumn("fold", F.col("fold").cast("string"))


def load(spark: SparkSession, path: str, fold: str, ids: DataFrame, version: str, problem=None, key: str = "clip_id", allowed: tuple[str, ...] = DEVELOPMENT) -> DataFrame:
    """The stored rows of one fold, all or nothing.

    Refused by name: a fold that isn't ``allowed``, a missing receipt, another version, data that changed since the receipt, ids (key) other than those wanted or
    stored twice, and rows for which ``problem``, a condition, holds.
    """
    if fold not in allowed:
        raise ManifestError(f"fold {fold} is not for this cache")
    receipt = receipts(spark, path).filter(F.col("fold") == fold).first()
    if receipt is None:
        raise ManifestError(f"no receipt of {fold}")
    if receipt["version"] != version:
        raise ManifestError(f"{fold} has version {receipt['version']}, not {version}")
    rows = stored(spark, path).filter(F.col("fold") == fold)
    found = content_digest(rows, ["fold"]).first()
    if found is None or found["digest"] != receipt["stored"]:
        raise ManifestError(f"{fold} is not what its receipt says")
    sides = rows.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(ids.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    if not sides.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a <> 1 or b <> 1").isEmpty():
        raise ManifestError(f"ids of {fold} are not those wanted")
    if problem is not None and not rows.filter(F.coalesce(problem, F.lit(True))).isEmpty():
        raise ManifestError(f"{fold} holds broken rows")
    return rows.drop("version")


def series_problem(series, bands: int = 4, steps: int = 64, frames: int = 61):
    """Whether a band series isn't ``bands`` x ``steps`` finite numbers from 0 on, zero after its frames."""
    bad = lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))
    return series.isNull() | (F.size(series) != bands) | F.exists(series, lambda b: (F.size(b) != steps) | F.exists(b, bad) | F.exists(F.slice(b, frames + 1, steps), lambda v: v != 0))


def recomputed(spark: SparkSession, path: str, inputs: DataFrame, build: Callable[[DataFrame], DataFrame], fold: str) -> DataFrame:
    """Check that the stored rows of a fold equal a recomputation exactly, row for row; failures are rows of one side only."""
    a = stored(spark, path).filter(F.col("fold") == fold).drop("version")
    b = build(inputs.filter(F.col("fold") == fold)).select(*a.columns)
    sides = a.withColumn("__s", F.lit(1)).unionByName(b.withColumn("__s", F.lit(-1)))
    return check(sides.groupBy(*a.columns).agg(F.sum("__s").alias("s")), f"{fold} as recomputed", F.col("s") != 0)
