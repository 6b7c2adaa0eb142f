"""The test tables in the roles of the domain, as DataFrames and as the same DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def windows(spark: SparkSession, sf_dir: str, faults: bool = False) -> DataFrame:
    """Scored windows (session, seq, p) from events; with ``faults`` errors abstain and every 50th window is lost."""
    e = table(spark, sf_dir, "events")
    p = F.least(F.col("value") / 100, F.lit(1.0))
    if faults:
        p = F.when(F.col("event_type") != "error", p)
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = e.select(F.col("user_id").alias("session"), seq.cast("long").alias("seq"), p.alias("p"))
    return rows.filter("seq % 50 <> 7") if faults else rows


def windows_sql(faults: bool = False) -> str:
    p = "least(value / 100, 1.0)"
    p = f"CASE WHEN event_type <> 'error' THEN {p} END" if faults else p
    where = " WHERE seq % 50 <> 7" if faults else ""
    return f"(SELECT * FROM (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, {p} AS p FROM events){where})"


#: Labelled predictions: class, group (pure by construction), fold and two scores.
PREDICTIONS_SQL = """(SELECT d.doc_id AS clip_id, l.quality AS y, concat(d.source, '-', l.quality) AS group_id,
  CASE CAST(substr(d.source, 4) AS INT) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS fold,
  CAST(n_chars AS DOUBLE) / (n_chars + 1500) AS p, CAST((n_chars * 7) % 997 AS DOUBLE) / 997 AS p_b, l.toxic, d.lang, md5(d.text) AS digest
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    n = F.col("n_chars")
    fold = F.element_at(F.array(*map(F.lit, ("train", "validation", "test"))), F.substring("source", 4, 9).cast("int") % 3 + 1)
    return d.join(labels, "doc_id").select(
        F.col("doc_id").alias("clip_id"), F.col("quality").alias("y"), F.concat_ws("-", "source", "quality").alias("group_id"), fold.alias("fold"),
        (n / (n + 1500)).alias("p"), ((n * 7) % 997 / 997).alias("p_b"), "toxic", "lang", F.md5("text").alias("digest"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores at volume: returned lines as positives, suppliers as keys, orders as groups."""
    x = table(spark, sf_dir, "lineitem")
    return x.select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_suppkey", F.col("l_orderkey").alias("group_id"), F.round(F.col("l_discount") * 100).cast("int").alias("p"))


LINES_SQL = "(SELECT CAST(l_returnflag = 'R' AS INT) AS y, l_suppkey, l_orderkey AS group_id, CAST(round(l_discount * 100) AS INT) AS p FROM lineitem)"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


SIGNALS_SQL = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
