"""Mixing sources to target weights by a low-discrepancy schedule.

Points of a golden-ratio sequence go through the cumulative target weights: as many points as the corpus has blocks
of ``block`` words are dealt, and a point is a slot of the source whose part it falls into. Slots are ranked per
source; the r-th slot of a source takes the r-th block of equal word length from its shuffled stream of documents,
which goes round up to ``most`` times. So the slots decide what is taken and when: the words of a source are its
slots times the block, which the sequence keeps near the target, and ``first_slot`` is a document's place in the mix.

Cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, last in
order; repeated rows each have their own place in the stream; an empty table, or one without words, gives
targets of 0; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echoline.llm.common import row_hash, running
from echoline.session import stored

#: Golden ratio as a fraction of 2**31, rounded to an odd number.
GOLDEN, PERIOD = 1327217885, 1 << 31
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """From rows (source, source_size): add weight, target, and ``lo``/``hi``, its part of [0, PERIOD).

    Weights repeat over sources in code-point order, null last. No target passes ``most`` times its source's
    size; the excess goes to the others by weight. One sorted pass finds that level: in the order of cap per
    weight, sources are full until the level of what is left no longer passes the next cap.
    The windows see one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("sid", F.row_number().over(order) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * most).withColumn("level", F.col("cap") / F.col("weight"))
    up = Window.orderBy("level", "sid")
    rows = rows.withColumns({
        "full_before": F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "weight_left": F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(Window.partitionBy()),
        "k": F.row_number().over(up),
    })
    rows = rows.withColumn("fill", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
    every = Window.partitionBy()
    first = F.min(F.when(F.col("fill") <= F.col("level"), F.struct("k", "fill"))).over(every)
    rows = rows.withColumn("stop", first)
    target = F.when(F.col("k") < F.col("stop.k"), F.col("cap").cast("double")).otherwise(F.least(F.col("stop.fill") * F.col("weight"), F.col("cap").cast("double")))
    rows = rows.withColumn("target", target).withColumn("goal", F.floor("target").cast("decimal(28,0)"))
    goals = F.sum("goal").over(Window.orderBy("sid"))
    edge = lambda x: F.coalesce(F.call_function("div", x * F.lit(PERIOD), F.nullif(F.sum("goal").over(every), F.lit(0))), F.lit(0)).cast("long")
    return rows.select("source", "sid", "source_size", "weight", "target", edge(goals - F.col("goal")).alias("lo"), edge(goals).alias("hi"))


def schedule(sources: DataFrame, block: int, chunk: int = 65536) -> DataFrame:
    """Slots (sid, rank, t): point t of the sequence belongs to the source whose part of [0, PERIOD) holds it.

    Points meet sources by an equi-join on cells of [0, PERIOD), four for each source.
    """
    spark = sources.sparkSession
    total, n = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count(F.lit(1))).first()
    cells = 4 * max(1, n)
    cell = lambda x: F.floor(x * cells / PERIOD).cast("long")
    parts = sources.filter("hi > lo").select("sid", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))).alias("cell"))
    points = spark.range(-(-total // block)).select(F.col("id").alias("t"), F.pmod(F.pmod(F.col("id"), F.lit(PERIOD)) * GOLDEN, F.lit(PERIOD)).alias("x")).withColumn("cell", cell(F.col("x")))
    dealt = points.join(parts, "cell").filter("x >= lo and x < hi").select("sid", "t", F.floor(F.col("t") / chunk).alias("chunk"), F.lit(1).cast("long").alias("one"))
    return running(dealt, "sid", "chunk", ["t"], "one", "rank").select("sid", "rank", "t")


def takes(docs: DataFrame, block: int = 64, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents in their sources' streams, takes): a take is a round of a document (sid, at) with its words taken and first slot.
    Streams keep the columns named by ``carry``.

    Documents of a source stand in the order of an MD5 of seed and id. All sums over a source go through hash
    buckets, so that a source with a third of all rows is no task of its own.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("th"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), digest.alias("place"), *carry)
    rows = stored(rows, "mix-docs")
    sources = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-sources")
    known = sources.withColumnRenamed("source", "__source")
    joined = rows.join(known, rows["source"].eqNullSafe(known["__source"])).drop("__source", "weight", "lo", "hi")
    joined = joined.withColumn("bucket", F.substring("place", 1, 3))
    streams = stored(running(joined, "sid", "bucket", ["place", "doc_id", "size"], "size", "at"), "mix-streams")

    rounds = (
        streams.filter("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        .withColumn("from", F.col("round") * F.col("source_size") + F.col("at")).withColumn("to", F.col("from") + F.col("size"))
    )
    pieces = rounds.select("sid", "at", "round", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))).alias("rank"))
    overlap = F.least("to", (F.col("rank") + 1) * block) - F.greatest("from", F.col("rank") * block)
    taken = pieces.join(schedule(sources, block), ["sid", "rank"]).groupBy("sid", "at", "round").agg(F.sum(overlap).alias("taken"), F.min("t").alias("slot"))
    return streams, taken


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per document: size, its source's size and target, the words that the mix takes of it and its first slot."""
    streams, rounds = takes(docs, **how)
    taken = rounds.groupBy("sid", "at").agg(F.sum("taken").alias("taken"), F.min("slot").alias("first_slot"))
    out = streams.join(taken, (streams["sid"] == taken["sid"]) & (streams["at"] == taken["at"]) & (streams["size"] > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "first_slot")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them, in the order of the slots, columns untouched.

    A document comes once for each round in which half of its words or more are taken. Only the last document that a
    source reaches is taken in part, so no more than half a document of a source is rounded away. Rows are told apart by all their
    columns: those that are equal in every column stand for each other, others with the same id and text don't.
    """
    marked = docs.withColumn("__row", row_hash(docs))
    streams, rounds = takes(marked, **how, carry=("__row",))
    own = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)))
    plan = rounds.join(streams.filter("size > 0"), ["sid", "at"]).filter(2 * F.col("taken") >= F.col("size")).select(own("doc_id").alias("__id"), F.col("th").alias("__th"), "__row", F.col("slot").alias("__slot"))
    rows = marked.withColumns({"__id": own("doc_id"), "__th": F.xxhash64("text")}).dropDuplicates(["__id", "__th", "__row"])
    out = rows.join(plan, ["__id", "__th", "__row"])
    return out.repartitionByRange("__slot").sortWithinPartitions("__slot").select(*docs.columns)


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place,
             coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
        row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s),
l AS (SELECT *, (3 * source_size)::DOUBLE / weight AS level,
        row_number() OVER (ORDER BY (3 * source_size)::DOUBLE / weight, sid) AS k FROM w),
f AS (SELECT *, ((SELECT sum(source_size) FROM s)
          - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
          / (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fill FROM l),
b AS (SELECT min(k) AS stop FROM f WHERE fill <= level),
t AS (SELECT source, sid, source_size,
        CASE WHEN k < stop THEN (3 * source_size)::DOUBLE
             ELSE least((SELECT fill FROM f, b WHERE k = stop) * weight, (3 * source_size)::DOUBLE) END AS target FROM f, b),
g AS (SELECT source, sid, source_size, target, (sum(floor(target)::HUGEINT) OVER (ORDER BY sid)) * 2147483648 // nullif(sum(floor(target)::HUGEINT) OVER (), 0) AS hi,
        (coalesce(sum(floor(target)::HUGEINT) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * 2147483648 // nullif(sum(floor(target)::HUGEINT) OVER (), 0) AS lo FROM t),
x AS (SELECT t, (t % 2147483648) * 1327217885 % 2147483648 AS x FROM range((SELECT ceil(coalesce(sum(source_size), 0) / 64)::BIGINT FROM s)) r(t)),
z AS (SELECT sid, t, row_number() OVER (PARTITION BY sid ORDER BY t) - 1 AS rank FROM x JOIN g ON x.x >= g.lo AND x.x < g.hi),
c AS (SELECT sid, count(*) * 64 AS words FROM z GROUP BY sid),
a AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.source, g.sid, coalesce(c.words, 0) AS words,
        coalesce(sum(size) OVER (PARTITION BY g.sid ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN c ON c.sid = g.sid)
SELECT doc_id, size, source_size, target, source, z.t AS first_slot,
  (SELECT sum(greatest(0, least(p * source_size + pos + size, words) - least(p * source_size + pos, words)))
   FROM (VALUES (0), (1), (2)) v(p))::BIGINT AS taken
FROM a LEFT JOIN z ON z.sid = a.sid AND z.rank = a.pos // 64 AND a.size > 0
"""
