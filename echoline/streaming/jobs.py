"""Durable jobs: a keyed table of jobs and previews as a log of committed batches, drained by a second streaming query.

A batch of changes is one folder, and counts once a commit names it. Both writes go to folders that the writer's name and the
batch's id decide, so a batch that is run again replaces what it wrote before. Of the changes to a key the highest ``version`` stands, of equal
versions the earliest batch: putting a job twice keeps the first, and a completion beats every later copy of its job. A completion
holds the deletion of the job and the update of its preview in one batch, so that both count or neither.

A change is (kind, event, what, version, gone, value): ``kind`` is ``job`` or ``preview``, (``event``, ``what``) the key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHANGE = "kind string, event string, what string, version int, gone boolean, value string"
LOG = f"{CHANGE}, writer string, batch long"
KEY = ("kind", "event", "what")
FALLBACK = "Temporal description unavailable; the durations come from the timestamped tracking."


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/commits/*", "writer string, batch long").distinct()


def _commit(spark: SparkSession, path: str, writer: str, batch: int) -> None:
    spark.createDataFrame([(writer, batch)], "writer string, batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{writer}-{batch}")


def apply(changes: DataFrame, path: str, writer: str, batch: int) -> None:
    """Write a batch of changes, then its commit. A batch that was committed is done; one that was cut short is written anew."""
    if not _commits(changes.sparkSession, path).filter((F.col("writer") == writer) & (F.col("batch") == batch)).isEmpty():
        return
    rows = changes.select(*[F.col(x.split(" ")[0]).cast(x.split(" ")[1]) for x in CHANGE.split(", ")])
    rows.write.mode("overwrite").parquet(f"{path}/changes/writer={writer}/batch={batch}")
    _commit(changes.sparkSession, path, writer, batch)


def _standing(spark: SparkSession, path: str) -> DataFrame:
    """The change that stands for each key, among committed batches."""
    latest = Window.partitionBy(*KEY).orderBy(F.desc("version"), "batch", "writer")
    rows = _read(spark, f"{path}/changes", LOG).join(_commits(spark, path), ["writer", "batch"], "left_semi")
    return rows.withColumn("k", F.row_number().over(latest)).filter("k = 1")


def current(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(event, what, version, value) of the keys of a kind that stand, from committed batches alone."""
    return _standing(spark, path).filter((F.col("kind") == kind) & ~F.col("gone")).select("event", "what", "version", "value")


def compact(spark: SparkSession, path: str, into: str) -> None:
    """Write what stands, and what is gone, as one batch of a new log; for a time when no query writes."""
    apply(_standing(spark, path), into, "compact", -1)


def enqueue(previews: DataFrame, path: str, writer: str = "tracker"):
    """A stream of previews (event, what, value, history): each batch puts the pending preview and its job."""

    def write(batch: DataFrame, batch_id: int) -> None:
        both = F.explode(F.array(
            F.struct(F.lit("preview").alias("kind"), F.col("value").alias("v")),
            F.struct(F.lit("job").alias("kind"), F.to_json(F.struct("value", "history")).alias("v")),
        ))
        rows = batch.dropDuplicates(["event", "what"]).withColumn("x", both)
        apply(rows.select("x.kind", "event", "what", F.lit(0).alias("version"), F.lit(False).alias("gone"), F.col("x.v").alias("value")), path, writer, batch_id)

    return previews.writeStream.foreachBatch(write).outputMode("append")


def completions(jobs: DataFrame, describe: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Changes that complete ``jobs`` (event, what, value): each is gone, its preview is ready with its description.

    ``describe`` gets (event, what, history) and gives (event, what, description, source); a job that it leaves out or gives no
    description for gets the fallback.
    """
    body = F.from_json("value", "value string, history string")
    asked = jobs.select("event", "what", body.alias("b")).select("event", "what", F.col("b.value").alias("preview"), F.col("b.history").alias("history"))
    told = describe(asked.select("event", "what", "history")).select("event", "what", "description", "source")
    done = asked.join(told, ["event", "what"], "left")
    text = F.coalesce("description", F.lit(FALLBACK))
    source = F.when(F.col("description").isNull(), "template_fallback").otherwise(F.coalesce("source", F.lit("template")))
    ready = F.to_json(F.struct(F.col("preview"), F.lit("ready").alias("status"), text.alias("description"), source.alias("description_source")))
    change = F.explode(F.array(
        F.struct(F.lit("job").alias("kind"), F.lit(True).alias("gone"), F.lit(None).cast("string").alias("v")),
        F.struct(F.lit("preview").alias("kind"), F.lit(False).alias("gone"), ready.alias("v")),
    ))
    return done.withColumn("x", change).select("x.kind", "event", "what", F.lit(1).alias("version"), "x.gone", F.col("x.v").alias("value"))


def drain(spark: SparkSession, path: str, describe: Callable[[DataFrame], DataFrame], source: str = "tracker", writer: str = "worker"):
    """A stream over the committed batches of ``source`` that completes the jobs pending then; restarted, it goes on with those left."""

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        put = _read(own, f"{path}/changes", LOG).join(batch.select("writer", "batch").distinct(), ["writer", "batch"], "left_semi").filter("kind = 'job'")
        pending = current(own, path, "job").join(put.select("event", "what").distinct(), ["event", "what"], "left_semi")
        apply(completions(pending, describe), path, writer, batch_id)

    commits = spark.readStream.schema("writer string, batch long").parquet(f"{path}/commits/{source}-*")
    return commits.writeStream.foreachBatch(write).outputMode("append")


def with_context(sessions: DataFrame, least: int = 31) -> DataFrame:
    """Sessions (session, health, history array) that may be described now: fresh, with at least ``least`` windows."""
    return sessions.filter((F.col("health") == "fresh") & (F.size("history") >= least))
