"""A training corpus from ``documents``: language, near-duplicates, benchmark leaks, mix, shards.

Every stage takes an empty table, other columns of any names, which it keeps, and equal ids; each says what becomes of nulls, of empty and very long texts,
of ties and of repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echoline.llm import decontaminate, langid, mixing, sharding, simhash
from echoline.session import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language.

    Null and empty texts, and texts without a letter, go; very long texts are read whole; of languages at equal distance the first by name counts; repeated
    rows stay or go together; a null lang or doc_id teaches nothing and doesn't matter otherwise; without any learned language all go.
    """
    return langid.in_known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: fingerprints within 2 bits, or five-word shingles that are alike by 0.8 or more.

    All texts without words, null or empty, are one group; very long texts are compared whole by their sketches; of a group the least doc_id stays, null
    before any other, of rows with its id and text one, decided by the other columns; repeated rows become one.
    """
    return simhash.one_of_each(docs, near=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts hold none and stay; very long texts are searched whole; repeated rows, and rows of equal id and text, stay or go together; an empty
    benchmark, or one of items without words, keeps all.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them.

    Null and empty texts have no words and are never taken; a very long text is taken where half of it or more is; a null source is a source of its own, last in
    order; ties in the shuffled order go by id and size; repeated rows have a place each.
    """
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot; columns of these names are replaced.

    Texts don't matter, be they null, empty or long; rows of one doc_id, null too, share a shard and have slots of their own.
    """
    return sharding.shard(docs, "doc_id", 24)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix", mix), ("shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages stands a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs


#: Hashes and profiles of the stages have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None
