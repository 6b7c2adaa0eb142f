"""Contract checks and dataset audits: every check is a row with its coverage; ``enforce`` raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that must never reach a report.
FORBIDDEN = ("label", "label_3c", "condition", "session_id", "fold")


def check(rows: DataFrame, name: str, bad) -> DataFrame:
    """One row: name, passed, coverage (rows looked at), failures."""
    return rows.agg(F.count(F.lit(1)).alias("coverage"), F.count_if(bad).alias("failures")).select(F.lit(name).alias("name"), (F.col("failures") == 0).alias("passed"), "coverage", "failures")


def prediction_contract(predictions: DataFrame, split: DataFrame) -> DataFrame:
    """Duplicate, unknown and missing ids and values outside [0, 1], over (clip_id, p) and (clip_id)."""
    ids = split.select("clip_id").distinct()
    known = predictions.join(ids.withColumn("known", F.lit(True)), "clip_id", "left")
    covered = ids.join(predictions.select("clip_id").distinct().withColumn("given", F.lit(True)), "clip_id", "left")
    p = F.col("p").cast("double")
    parts = [
        check(predictions.groupBy("clip_id").count(), "no_duplicate_id", F.col("count") > 1),
        check(known, "no_unknown_id", F.col("known").isNull()),
        check(covered, "no_missing_id", F.col("given").isNull()),
        check(predictions, "finite_probability", p.isNull() | F.isnan(p) | ~p.between(0, 1)),
    ]
    return reduce(DataFrame.unionByName, parts)


def crossing(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Check that no value of ``key`` lies in several folds."""
    return check(rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct("fold").alias("folds")), name, F.col("folds") > 1)


def originals(split: DataFrame, paths: DataFrame, files: DataFrame, digest=None) -> DataFrame:
    """Checks that a split (clip_id), its audit (clip_id, path, digest) and files (path, content) are one set, byte for byte.

    ``digest`` makes the audit's digest from ``content``; MD5 unless given. Each failing id or path counts once.
    """
    found = F.md5("content") if digest is None else digest
    ids = split.select("clip_id").distinct().withColumn("s", F.lit(True))
    both = ids.join(paths.select("clip_id", "path", "digest").withColumn("a", F.lit(True)), "clip_id", "full_outer")
    read = both.filter("a").join(files.select("path", found.alias("__found")).withColumn("f", F.lit(True)), "path", "left")
    parts = [
        check(both, "every clip has its path", F.col("a").isNull()), check(both, "no path without a clip", F.col("s").isNull()), check(paths.groupBy("clip_id").count(), "one path for a clip", F.col("count") > 1),
        check(read, "every path has its file", F.col("f").isNull()), check(read.filter("f"), "files byte for byte", ~F.col("__found").eqNullSafe(F.col("digest"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def enforce(checks: DataFrame) -> None:
    failed = [r["name"] for r in checks.filter("not passed").collect()]
    if failed:
        raise ValueError("checks failed: " + ", ".join(failed))


def forbid(rows: DataFrame, names: tuple[str, ...] = FORBIDDEN) -> DataFrame:
    """``rows`` if none of the forbidden columns is there."""
    found = sorted(set(rows.columns) & set(names))
    if found:
        raise ValueError("forbidden columns: " + ", ".join(found))
    return rows


def within_capacity(rows: DataFrame, key: str, keys: int, per_key: int) -> DataFrame:
    """Checks that there are at most so many keys, and so many rows of each; nothing is dropped."""
    counts = rows.groupBy(key).count()
    many = check(counts, "rows_per_key", F.col("count") > per_key)
    return many.unionByName(counts.agg(F.count(F.lit(1)).alias("coverage")).select(
        F.lit("keys").alias("name"), (F.col("coverage") <= keys).alias("passed"), "coverage", F.greatest(F.lit(0).cast("long"), F.col("coverage") - keys).alias("failures")
    ))


def same_values(declared: DataFrame, computed: DataFrame, key: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """Check of a report against its recomputation: each key on both sides, values equal within a tolerance or both null."""
    a, b = declared.select(key, F.col(value).alias("__a"), F.lit(True).alias("__da")), computed.select(key, F.col(value).alias("__b"), F.lit(True).alias("__db"))
    both = a.join(b, key, "full_outer")
    close = F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.col("__a").isNull() & F.col("__b").isNull()).otherwise(F.abs(F.col("__a") - F.col("__b")) <= tolerance)
    return check(both, f"same_{value}", F.col("__da").isNull() | F.col("__db").isNull() | ~close)


def exhaustive_pairs(log: DataFrame, queries: DataFrame, records: DataFrame) -> DataFrame:
    """Check that an overlap log (query, record) has every query with every record, once: counts per query, no product."""
    n = records.select("record").distinct().count()
    known = log.join(records.select("record").distinct(), "record", "left_semi")
    per = queries.select("query").distinct().join(known.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record").alias("d")), "query", "left")
    return check(per, "every_pair_once", ~((F.col("n") == n) & (F.col("d") == n)) | F.col("n").isNull())
