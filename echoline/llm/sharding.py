"""Sharding by jump consistent hashing: stable keys to shards without a ring table.

Cases: a null key hashes like key 0 of its own kind (the hash of null); repeated rows of a key share its
shard and take consecutive-order slots; a null text has size 8 and checksum 0; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoline.llm.common import running


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Bucket of each 64-bit key among ``shards``: each key jumps ahead until it passes the last shard."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key, last, ahead = keys.astype(np.uint64), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    going = np.arange(len(keys))
    while len(going):
        last[going] = ahead[going]
        k = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
        key[going] = k
        ahead[going] = np.floor((last[going] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        going = going[ahead[going] < shards]
    return last.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key column of any type, from its 64-bit hash; vectorised over Arrow batches."""

    @F.pandas_udf("int")
    def place(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy(np.int64), shards))

    return place(F.xxhash64(key))


def shard(docs: DataFrame, key: str, shards: int, buckets: int = 1024, order: list[str] | None = None, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """Add ``shard_col`` and ``slot_col``, numbered from 0 without gaps in each shard.

    A shard may hold more rows than a task should: slots count inside (shard, hash bucket) and start after the
    buckets before, from a scan of the key alone.
    """
    placed = lambda df: df.withColumn(shard_col, shard_of(F.col(key), shards)).withColumn("__bucket", F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(buckets)))
    one = F.lit(1).cast("long")
    out = running(
        placed(docs).withColumn("__one", one), shard_col, "__bucket", [key, *(order or [])], "__one", slot_col,
        totals=placed(docs.select(key)).withColumn("__one", one),
    )
    return out.drop("__bucket", "__one")


def sharded_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: size, checksum, shard, slot and its shard once a shard is appended."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard(rows, "doc_id", shards, order=["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"))
