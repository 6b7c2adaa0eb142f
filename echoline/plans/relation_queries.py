"""Registered queries of relations between tables: manifests, coverage, shared content, intervals, inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoline.functions import display as D
from echoline.operators import alignment, resampling, timeline
from echoline.plans.registry import query, rounded
from echoline.plans.tables import PREDICTIONS_SQL, predictions, signals, table
from echoline.sources import manifests
from echoline.streaming import incidents


@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def manifest_join(spark, sf_dir):
    named = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return alignment.with_files(table(spark, sf_dir, "orders"), named, "o_custkey", check_all=True).select("o_orderkey", "c_name")


@query(f"SELECT clip_id, y, p, p_b FROM {PREDICTIONS_SQL}")
def aligned_vectors(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return alignment.side_by_side(p.select("clip_id", "y"), {"p": p.select("clip_id", "p"), "p_b": p.select("clip_id", F.col("p_b").alias("p"))})


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark, sf_dir):
    return alignment.lacking(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def coverage_restriction(spark, sf_dir):
    return alignment.covered(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING n > 1")
def digest_matches(spark, sf_dir):
    return alignment.copies(table(spark, sf_dir, "documents"), F.md5("text"), "doc_id").withColumnRenamed("first", "first_id")


@query(f"SELECT digest, count(DISTINCT fold) AS folds FROM {PREDICTIONS_SQL} GROUP BY digest HAVING min(fold) <> max(fold)")
def cross_fold_violations(spark, sf_dir):
    return alignment.across(predictions(spark, sf_dir), "digest", "fold").filter("fold > 1").select("digest", F.col("fold").alias("folds"))


@query(f"SELECT digest, count(DISTINCT y) AS classes, count(*) AS n FROM {PREDICTIONS_SQL} GROUP BY digest HAVING n > 1")
def duplicate_across_classes(spark, sf_dir):
    return alignment.across(predictions(spark, sf_dir), "digest", "y").select("digest", F.col("y").alias("classes"), "n")


@query("""SELECT s.l_suppkey, s.l_linenumber, s.l_orderkey, s.k, arg_min(o.o_orderkey, (o.k0, o.o_orderkey)) AS incident
FROM (SELECT l_suppkey, l_linenumber, l_orderkey, datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS k FROM lineitem) s
LEFT JOIN (SELECT DISTINCT l_suppkey, o_orderkey, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS k0, CASE WHEN o_orderstatus <> 'P' THEN datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2 + o_orderkey % 9 END AS k1
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) o ON s.l_suppkey = o.l_suppkey AND s.k >= o.k0 AND (o.k1 IS NULL OR s.k < o.k1) GROUP BY ALL""")
def interval_join(spark, sf_dir):
    """Each shipped line with the first order of its supplier that is open on that day; an order is an incident of the suppliers of all its lines."""
    days = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    x = table(spark, sf_dir, "lineitem")
    s = x.select("l_suppkey", "l_linenumber", "l_orderkey", days("l_shipdate").alias("k"))
    o = table(spark, sf_dir, "orders").withColumn("k0", days("o_orderdate")).withColumn("k1", F.when(F.col("o_orderstatus") != "P", F.col("k0") + 2 + F.col("o_orderkey") % 9))
    lead = x.select("l_suppkey", F.col("l_orderkey").alias("o_orderkey")).distinct()
    return timeline.open_incident(s, o.join(lead, "o_orderkey").select("l_suppkey", F.col("o_orderkey").alias("incident"), "k0", "k1"), "l_suppkey")


@query("""WITH k AS (SELECT c_custkey, n_nationkey, abs(c_custkey % 50 - n_regionkey * 10.0) AS d FROM customer, nation) SELECT c_custkey, arg_min(n_nationkey, (d, n_nationkey)) AS n_nationkey, CAST(min(d) AS DOUBLE) AS d FROM k GROUP BY c_custkey""")
def nearest_segment(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") * 10.0).alias("x"))
    c, zero = table(spark, sf_dir, "customer"), F.lit(0.0)
    # The network is a fixed drawing (25 segments): it travels as one array.
    drawn = n.agg(F.collect_list(F.struct("n_nationkey", "x")).alias("net"))
    point = (F.col("c_custkey") % 50).cast("double")
    far = F.transform("net", lambda s: F.struct(D.nearest_on_segment(point, zero, s["x"], zero, s["x"], zero)["distance"].alias("d"), s["n_nationkey"].alias("n_nationkey")))
    return c.crossJoin(F.broadcast(drawn)).select("c_custkey", F.array_min(far).alias("b")).select("c_custkey", "b.n_nationkey", "b.d")


@query("WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), k AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings) SELECT vec_id, label FROM k JOIN n USING (label) WHERE k % greatest(1, CAST(ceil(n / 72.0) AS INT)) = 0")
def downsampled(spark, sf_dir):
    return D.shown(signals(spark, sf_dir).select("vec_id", "label"), "label", "vec_id")


@query("SELECT k, CASE WHEN max(s) = 0 THEN 'left' ELSE 'right' END AS side FROM (SELECT c_custkey AS k, 0 AS s FROM customer UNION SELECT o_custkey + 40, 1 FROM orders) GROUP BY k HAVING count(*) = 1")
def set_difference(spark, sf_dir):
    return alignment.difference(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select((F.col("o_custkey") + 40).alias("k")), "k")


@query("SELECT c_nationkey AS k, ['customer', 'supplier'] AS parts FROM customer INTERSECT SELECT s_nationkey, ['customer', 'supplier'] FROM supplier")
def set_intersection(spark, sf_dir):
    parts = {"customer": table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "k"), "supplier": table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "k")}
    return alignment.common(parts, "k")


@query("SELECT c_custkey AS k, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier")
def inventory_union(spark, sf_dir):
    return alignment.inventory({"customer": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "supplier": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))})


@query(f"""SELECT count(*) AS n, round(max(abs(p - p_b)), 12) AS largest, count(*) FILTER (abs(p - p_b) > 0.000001) AS beyond, count(*) FILTER ((p >= 0.5) <> (p_b >= 0.5)) AS flips, arg_min(clip_id, (-abs(p - p_b), clip_id)) AS worst FROM {PREDICTIONS_SQL}""")
def score_spread(spark, sf_dir):
    routes = predictions(spark, sf_dir).select("clip_id", F.explode(F.array("p", "p_b")).alias("p"))
    return rounded(resampling.score_spread(routes), "largest", digits=12)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS sources, max(event_id) AS latest FROM events GROUP BY event_type")
def incident_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("event"), F.col("user_id").alias("source"), F.col("event_id").alias("at"))
    return incidents.counters(e).withColumnRenamed("event", "event_type")


@query(r"""WITH p AS (SELECT page_id, concat(CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '../' WHEN 3 THEN 'c:' ELSE 'a/./' END, regexp_replace(url, '^https?://', '')) AS path FROM pages)
SELECT page_id, NOT (contains(path, ':') OR contains(path, '\') OR len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..'))) > 0) AS safe FROM p""")
def safe_paths(spark, sf_dir):
    lead = F.element_at(F.array(*map(F.lit, ("", "/", "../", "c:", "a/./"))), (F.col("page_id") % 5 + 1).cast("int"))
    path = F.concat(lead, F.regexp_replace("url", "^https?://", ""))
    return table(spark, sf_dir, "pages").select("page_id", manifests.safe_path(path).alias("safe"))


@query("SELECT event_id, (CAST(floor(value) AS BIGINT) - 50) % 7 + CASE WHEN (CAST(floor(value) AS BIGINT) - 50) % 7 < 0 THEN 7 ELSE 0 END AS m FROM events")
def positive_modulo(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", D.loop_time(F.floor("value") - 50, F.lit(7).cast("long")).alias("m"))


@query("SELECT page_id, concat('page_', sha256(concat('page', chr(0), url, chr(0), CAST(length(html) AS VARCHAR)))) AS id FROM pages")
def path_digest(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", manifests.stable_id("page", F.col("url"), F.length("html")).alias("id"))
