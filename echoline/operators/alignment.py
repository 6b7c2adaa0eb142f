"""Tables of a study laid side by side: manifests with their files, scores of two runs, what one side lacks, shared content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoline.operators.audit import check


def with_files(manifest: DataFrame, files: DataFrame, key: str, check_all: bool = False) -> DataFrame:
    """Rows of the manifest with the columns of their file; ``check_all`` raises if a row has none or a key several files."""
    if check_all:
        unknown = manifest.join(files.select(key), key, "left_anti")
        if not unknown.isEmpty() or not files.groupBy(key).count().filter("count > 1").isEmpty():
            raise ValueError(f"not every {key} has exactly one file")
    return manifest.join(files, key)


def side_by_side(split: DataFrame, runs: dict[str, DataFrame], score: str = "p") -> DataFrame:
    """Clips of a split that every run has scored, with one column per run: ``score`` of run name -> (clip_id, score)."""
    parts = [run.select("clip_id", F.col(score).alias(name)) for name, run in runs.items()]
    return reduce(lambda a, b: a.join(b, "clip_id"), parts, split)


def lacking(required: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Rows of ``required`` whose key is not given; a null key is never given."""
    return required.join(given.select(key), key, "left_anti")


def covered(rows: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Rows whose key is given, each once however often it is given."""
    return rows.join(given.select(key), key, "left_semi")


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of the distinct keys of one side only; null is a key. Both sides meet in one aggregation."""
    sides = left.select(key).withColumn("__s", F.lit(0)).unionByName(right.select(key).withColumn("__s", F.lit(1)))
    per = sides.groupBy(key).agg(F.min("__s").alias("lo"), F.max("__s").alias("hi")).filter("lo = hi")
    return per.select(key, F.when(F.col("lo") == 0, "left").otherwise("right").alias("side"))


def common(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that lie in at least two of the named parts, with the sorted names; empty if the parts are apart."""
    tagged = reduce(DataFrame.unionByName, [p.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("part", F.lit(n)) for n, p in parts.items()])
    return tagged.groupBy(key).agg(F.sort_array(F.collect_list("part")).alias("parts")).filter(F.size("parts") > 1)


def apart(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Check that no key lies in two of the parts."""
    return check(common(parts, key), f"{key}_apart", F.lit(True))


def inventory(parts: dict[str, DataFrame]) -> DataFrame:
    """All rows of the named parts of an inventory under each other, with their ``kind``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("kind", F.lit(n)) for n, p in parts.items()])


def copies(rows: DataFrame, digest: Column, order: str) -> DataFrame:
    """(digest, n, first) of contents that several rows share; rows without a digest are left out."""
    return rows.withColumn("digest", digest).filter("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).filter("n > 1")


def across(rows: DataFrame, key: str, *named: str) -> DataFrame:
    """Per key that several rows share: its rows and, for each named column, how many values of it the key meets."""
    per = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.countDistinct(c).alias(c) for c in named])
    return per.filter("n > 1")
