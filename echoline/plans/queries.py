"""Registered queries of the library's own operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from echoline.functions import config, features
from echoline.functions import signals as S
from echoline.operators import audit, metrics, ranking, resampling, timeline, tracking
from echoline.plans.registry import query, rounded
from echoline.plans.tables import LINES_SQL, PREDICTIONS_SQL, SIGNALS_SQL, lines, predictions, signals, table, windows, windows_sql


# --- tracking ---------------------------------------------------------------------------------------------------
TRACK = """
WITH w AS (SELECT *, seq - lag(seq, 1, -1) OVER s - 1 AS missing,
  row_number() OVER s = 1 OR seq - lag(seq, 1, -1) OVER s > 1 OR p IS NULL OR lag(p) OVER s IS NULL AS brk
  FROM {rows} r WINDOW s AS (PARTITION BY session ORDER BY seq)),
i AS (SELECT *, sum(CAST(brk OR coalesce(p, 0) < 0.8 AS INT)) OVER s AS hi_island, sum(CAST(brk OR coalesce(p, 1) > 0.4 AS INT)) OVER s AS lo_island
  FROM w WINDOW s AS (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, sum(CAST(coalesce(p, 0) >= 0.8 AS INT)) OVER (PARTITION BY session, hi_island ORDER BY seq ROWS UNBOUNDED PRECEDING) AS high_run,
  sum(CAST(coalesce(p, 1) <= 0.4 AS INT)) OVER (PARTITION BY session, lo_island ORDER BY seq ROWS UNBOUNDED PRECEDING) AS low_run FROM i),
t AS (SELECT *, CASE WHEN high_run >= 3 THEN 1 WHEN low_run >= 5 THEN 0 END AS trig FROM r),
s AS (SELECT *, coalesce(last_value(trig IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS state FROM t),
q AS (SELECT *, lag(state, 1, 0) OVER (PARTITION BY session ORDER BY seq) AS was FROM s),
e AS (SELECT *, state = 1 AND was = 0 AS opened, state = 0 AND was = 1 AS ended, state = 1 OR was = 1 AS inside,
  sum(CAST(state = 1 AND was = 0 AS INT)) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS event FROM q),
c AS (SELECT *, sum(CAST(inside AND p IS NOT NULL AS INT)) OVER b + 2 AS observed_, sum(CAST(inside AND coalesce(p, 0) >= 0.8 AS INT)) OVER b + 2 AS high_,
  max(CAST(inside AND brk AND NOT opened AS INT)) OVER b = 1 AS interrupted_, inside AND state = 1 AND high_run > {over} AS over_ FROM e
  WINDOW b AS (PARTITION BY session, event ORDER BY seq ROWS UNBOUNDED PRECEDING)),
tracked AS (SELECT *, over_ AND sum(CAST(over_ AS INT)) OVER (PARTITION BY session, event ORDER BY seq ROWS UNBOUNDED PRECEDING) = 1 AS persistent FROM c)
"""
CHANGES = """SELECT session, CAST(event AS BIGINT) AS event, kind, seq, CAST(observed_ AS BIGINT) AS observed, CAST(high_ AS BIGINT) AS high, interrupted_ AS interrupted
FROM (SELECT *, unnest(['opened', 'persistent', 'ended']) AS kind, unnest([opened, persistent, ended]) AS is_kind FROM tracked) WHERE is_kind"""


def track_sql(faults: bool, over: int) -> str:
    return TRACK.format(rows=windows_sql(faults), over=over)


@query(track_sql(False, 4) + CHANGES)
def event_tracking(spark, sf_dir):
    return tracking.transitions(tracking.track(windows(spark, sf_dir), persist_over=4))


@query(track_sql(True, 4) + CHANGES)
def event_tracking_with_gaps(spark, sf_dir):
    return tracking.transitions(tracking.track(windows(spark, sf_dir, True), persist_over=4))


@query(track_sql(True, 4) + """SELECT session, CAST(event AS BIGINT) AS event, min(seq) AS first_seq, max(seq) AS last_seq,
  CAST(max(observed_) AS BIGINT) AS observed, CAST(max(high_) AS BIGINT) AS high, max(CAST(interrupted_ AS INT)) AS interrupted, max(CAST(ended AS INT)) AS closed
FROM tracked WHERE inside GROUP BY session, event""")
def event_table(spark, sf_dir):
    t = tracking.track(windows(spark, sf_dir, True), persist_over=4).filter("state = 1 or was = 1")
    top = lambda c: F.max(F.col(c).cast("int")).alias({"ended": "closed"}.get(c, c))
    return t.groupBy("session", "event").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max("observed").alias("observed"), F.max("high").alias("high"), top("interrupted"), top("ended"))


@query(track_sql(True, 4) + "SELECT session, count(*) AS windows, CAST(sum(missing) AS BIGINT) AS missing, count(*) FILTER (brk) AS breaks, CAST(max(high_run) AS BIGINT) AS longest_high, CAST(max(low_run) AS BIGINT) AS longest_low FROM tracked GROUP BY session")
def gaps_and_runs(spark, sf_dir):
    t = tracking.track(windows(spark, sf_dir, True))
    return t.groupBy("session").agg(F.count(F.lit(1)).alias("windows"), F.sum("missing").alias("missing"), F.count_if("brk").alias("breaks"), F.max("high_run").alias("longest_high"), F.max("low_run").alias("longest_low"))


@query(track_sql(False, 4) + "SELECT session, event, kind, CASE kind WHEN 'opened' THEN printf('Session %d: activity confirmed at window %d.', session, seq) WHEN 'persistent' THEN printf('Session %d: activity persists after %d high windows.', session, high) ELSE printf('Session %d: activity ended after %d windows.', session, observed) END AS message, false AS sent FROM (" + CHANGES + ")")
def preview_outbox(spark, sf_dir):
    return tracking.previews(tracking.transitions(tracking.track(windows(spark, sf_dir), persist_over=4)))


@query(f"""WITH w AS (SELECT session, seq, p, list(p) OVER (PARTITION BY session ORDER BY seq ROWS 63 PRECEDING) AS h FROM {windows_sql()})
SELECT session, seq, len(h) AS n, round(list_aggregate(h, 'avg'), 12) AS mean, h[1] AS oldest FROM w""")
def history_frame(spark, sf_dir):
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(-63, 0)
    h = windows(spark, sf_dir).withColumn("h", F.collect_list("p").over(w))
    return rounded(h.select("session", "seq", F.size("h").cast("long").alias("n"), S.mean(F.col("h")).alias("mean"), F.col("h")[0].alias("oldest")), "mean", digits=12)


@query(f"""WITH w AS (SELECT session, seq, p >= 0.8 AS hi, p <= 0.4 AS lo, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS back,
  sum(CAST(p < 0.8 AS INT)) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS isl, sum(CAST(p < 0.8 AS INT)) OVER (PARTITION BY session) AS last_isl FROM {windows_sql()}),
r AS (SELECT session, isl, any_value(last_isl) AS last_isl, count(*) FILTER (hi) AS n FROM w GROUP BY session, isl),
f AS (SELECT session, count(*) FILTER (n > 0) AS runs, max(n) FILTER (isl = last_isl) AS current, max(n) AS longest, sum(n)::BIGINT AS total FROM r GROUP BY session),
q AS (SELECT session, count(*) AS size, bool_and(lo) FILTER (back <= 5) AS quiet FROM w GROUP BY session)
SELECT session, runs, coalesce(current, 0) AS current, longest, total, CASE WHEN coalesce(current, 0) > 30 THEN 'persistent' WHEN total > 0 AND size >= 5 AND quiet THEN 'ended'
  WHEN runs > 1 THEN 'intermittent' WHEN total > 0 THEN 'brief' ELSE 'quiet' END AS pattern FROM f JOIN q USING (session)""")
def run_facts(spark, sf_dir):
    h = windows(spark, sf_dir).groupBy("session").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "p"))), lambda s: s["p"]).alias("h"))
    f = h.select("session", tracking.facts(F.col("h")).alias("f"))
    return f.select("session", *[F.col(f"f.{c}").cast("long").alias(c) for c in ("runs", "current", "longest", "total")], "f.pattern")


# --- metrics ----------------------------------------------------------------------------------------------------
CONF = """count(*) FILTER (y = 1 AND p >= {t}) AS tp, count(*) FILTER (y = 0 AND p >= {t}) AS fp, count(*) FILTER (y = 0 AND p < {t}) AS tn, count(*) FILTER (y = 1 AND p < {t}) AS fn"""
BLOCK = """SELECT {by}, tp, fp, tn, fn, tp / nullif(tp + fn, 0) AS recall, fp / nullif(tn + fp, 0) AS fpr, tp / nullif(tp + fp, 0) AS precision,
  coalesce((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0)) AS balanced_accuracy,
  (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0)) / 2 AS macro_f1 FROM c"""


@query(f"WITH c AS (SELECT l_suppkey, {CONF.format(t=5)} FROM {LINES_SQL} GROUP BY l_suppkey) " + BLOCK.format(by="l_suppkey"))
def metric_block(spark, sf_dir):
    return metrics.metric_block(lines(spark, sf_dir), 5, ["l_suppkey"])


GROUPS = f"(SELECT group_id, median(p) AS p, max(y) AS y, min(y) <> max(y) AS mixed, count(*) AS n FROM {LINES_SQL} GROUP BY group_id)"


@query(f"SELECT * FROM {GROUPS}")
def group_median(spark, sf_dir):
    return metrics.group_medians(lines(spark, sf_dir))


@query(f"""WITH x AS (SELECT 'clip' AS level, y, CAST(p AS DOUBLE) AS p FROM {LINES_SQL} UNION ALL SELECT 'group', y, p FROM {GROUPS}),
c AS (SELECT level, {CONF.format(t=5)} FROM x GROUP BY level) """ + BLOCK.format(by="level"))
def two_level_report(spark, sf_dir):
    rows = lines(spark, sf_dir)
    both = rows.select(F.lit("clip").alias("level"), "y", F.col("p").cast("double").alias("p")).unionByName(metrics.group_medians(rows).select(F.lit("group").alias("level"), "y", "p"))
    return metrics.metric_block(both, 5, ["level"])


AUC = """h AS (SELECT {by}, p, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM x GROUP BY {by}, p),
u AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {by} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under FROM h),
auc AS (SELECT {by}, CAST(sum(pos * (2 * under + neg)) AS DOUBLE) / nullif(CAST(2 * sum(pos) * sum(neg) AS DOUBLE), 0) AS roc_auc FROM u GROUP BY {by})"""


@query(f"WITH x AS {LINES_SQL}, {AUC.format(by='l_suppkey')} SELECT * FROM auc")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(lines(spark, sf_dir), ["l_suppkey"])


@query(f"""WITH x AS {LINES_SQL}, h AS (SELECT l_suppkey, p, sum(y)::BIGINT AS pos, count(*) AS n FROM x GROUP BY l_suppkey, p),
c AS (SELECT l_suppkey, pos, n, sum(pos) OVER w AS tp, sum(n) OVER w AS all_ FROM h WINDOW w AS (PARTITION BY l_suppkey ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
SELECT l_suppkey, round(CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0 THEN sum(CAST(pos * tp AS DOUBLE) / all_) / sum(pos) END, 9) AS pr_auc FROM c GROUP BY l_suppkey""")
def average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(lines(spark, sf_dir), ["l_suppkey"]), "pr_auc")


@query(f"SELECT fold, round(avg((p - y) * (p - y)), 9) AS brier FROM {PREDICTIONS_SQL} GROUP BY fold")
def brier(spark, sf_dir):
    return rounded(metrics.brier(predictions(spark, sf_dir), ["fold"]), "brier")


@query(f"""WITH x AS (SELECT l_suppkey, y, CAST(p AS DOUBLE) AS p FROM {LINES_SQL}), h AS (SELECT l_suppkey, p, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM x GROUP BY l_suppkey, p),
a AS (SELECT * FROM h UNION ALL SELECT l_suppkey, min(p) - 1e-9, 0, 0 FROM h GROUP BY l_suppkey UNION ALL SELECT l_suppkey, max(p) + 1e-9, 0, 0 FROM h GROUP BY l_suppkey),
k AS (SELECT l_suppkey, p, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY l_suppkey) AS np, sum(neg) OVER (PARTITION BY l_suppkey) AS nn FROM a WINDOW w AS (PARTITION BY l_suppkey ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
f AS (SELECT l_suppkey, p, (coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + np - tp, 0), 0) + coalesce(CAST(2 * (nn - fp) AS DOUBLE) / nullif(2 * (nn - fp) + np - tp + fp, 0), 0)) / 2 AS macro_f1 FROM k)
SELECT l_suppkey, p AS threshold, macro_f1 FROM f QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY macro_f1 DESC, p) = 1""")
def threshold_pick(spark, sf_dir):
    return metrics.pick_threshold(lines(spark, sf_dir).withColumn("p", F.col("p").cast("double")), ["l_suppkey"])


DRAWS = """g AS (SELECT group_id, row_number() OVER (ORDER BY md5(group_id), group_id) - 1 AS r FROM (SELECT DISTINCT group_id FROM pr)), n AS (SELECT count(*) AS n FROM g),
d AS (SELECT draw, k, CAST('0x' || substr(md5('s:' || draw || ':' || k), 1, 12) AS BIGINT) % n AS r FROM n, range({draws}) a(draw), range(n) b(k)),
dr AS (SELECT draw, k, group_id FROM d JOIN g USING (r))"""
MEDIANS = "m AS (SELECT group_id, median(p) AS p, median(p_b) AS p_b, max(y) AS y FROM pr GROUP BY group_id)"


def _drawn(spark, sf_dir, n):
    rows = predictions(spark, sf_dir)
    groups = rows.groupBy("group_id").agg(F.median("p").alias("p"), F.median("p_b").alias("p_b"), F.max("y").alias("y"))
    return groups, metrics.draws(groups, n, "s")


@query(f"""WITH pr AS {PREDICTIONS_SQL}, {MEDIANS}, {DRAWS.format(draws=config.DRAWS)}, x AS (SELECT draw, y, p FROM dr JOIN m USING (group_id)), {AUC.format(by='draw')}
SELECT round(quantile_cont(roc_auc, 0.025), 9) AS low, round(quantile_cont(roc_auc, 0.975), 9) AS high, count(*) AS draws FROM auc WHERE roc_auc IS NOT NULL""")
def bootstrap_ci(spark, sf_dir):
    groups, drawn = _drawn(spark, sf_dir, config.DRAWS)
    return rounded(metrics.interval(metrics.bootstrap_auc(groups, drawn), "roc_auc"), "low", "high")


#: AUC of both scores per key ``<draw>/a`` and ``<draw>/b`` of x; their differences by draw, and that of all groups without a draw.
DELTA = """v AS (SELECT split_part(key, '/', 1) AS draw, max(roc_auc) FILTER (key LIKE '%a') - max(roc_auc) FILTER (key LIKE '%b') AS delta FROM auc GROUP BY 1),
o AS (SELECT delta AS observed FROM v WHERE draw = 'all')
SELECT round(observed, 9) AS observed, low, high, draws, CASE WHEN low > 0 THEN 'A better' WHEN high < 0 THEN 'B better' ELSE 'inconclusive' END AS verdict
FROM (SELECT round(quantile_cont(delta, 0.025), 9) AS low, round(quantile_cont(delta, 0.975), 9) AS high, count(*) AS draws FROM v WHERE delta IS NOT NULL AND draw <> 'all') CROSS JOIN o"""
BOTH = """x AS (SELECT draw || '/a' AS key, y, p FROM b UNION ALL SELECT draw || '/b', y, p_b FROM b)"""


@query(f"""WITH pr AS {PREDICTIONS_SQL}, {MEDIANS}, {DRAWS.format(draws=config.DRAWS)}, b AS (SELECT CAST(draw AS VARCHAR) AS draw, y, p, p_b FROM dr JOIN m USING (group_id) UNION ALL SELECT 'all', y, p, p_b FROM m),
{BOTH}, {AUC.format(by='key')}, {DELTA}""")
def paired_delta(spark, sf_dir):
    groups, drawn = _drawn(spark, sf_dir, config.DRAWS)
    return rounded(resampling.paired_delta(groups, drawn), "observed", "low", "high")


@query(f"SELECT fold, count(*) FILTER (y = 0) AS negative, count(*) FILTER (y = 1) AS positive FROM {PREDICTIONS_SQL} GROUP BY fold")
def label_distribution(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("fold").pivot("y", [0, 1]).count().fillna(0).toDF("fold", "negative", "positive")


@query(f"""SELECT fold, count(*) AS n, count(DISTINCT p) AS values_, max(c) AS top, CAST(max(c) AS DOUBLE) / count(*) AS top_share FROM (SELECT fold, p, count(*) OVER (PARTITION BY fold, p) AS c FROM {PREDICTIONS_SQL}) GROUP BY fold""")
def score_inspection(spark, sf_dir):
    c = predictions(spark, sf_dir).groupBy("fold", "p").count()
    return c.groupBy("fold").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("values_"), F.max("count").alias("top"), (F.max("count") / F.sum("count")).alias("top_share"))


# --- ranks over all rows, spread over tasks -----------------------------------------------------------------------
@query(f"""WITH b AS (SELECT (row_number() OVER (ORDER BY md5(CAST(clip_id AS VARCHAR)), clip_id) - 1) // 16 AS batch, y, group_id FROM {PREDICTIONS_SQL})
SELECT batch, count(*) AS n, CAST(sum(y) AS BIGINT) AS positive, count(DISTINCT group_id) AS groups_ FROM b GROUP BY batch""")
def batch_composition(spark, sf_dir):
    b = ranking.ranked(predictions(spark, sf_dir), "clip_id", "k").withColumn("batch", F.floor((F.col("k") - 1) / 16))
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positive"), F.countDistinct("group_id").alias("groups_"))


@query(f"SELECT group_id, y, (row_number() OVER (PARTITION BY y ORDER BY md5(concat('seed:', group_id)), group_id) - 1) % 3 AS cv_fold FROM (SELECT DISTINCT group_id, y FROM {PREDICTIONS_SQL})")
def stratified_folds(spark, sf_dir):
    return ranking.grouped_folds(predictions(spark, sf_dir), 3, "seed")


@query(f"""WITH g AS (SELECT DISTINCT group_id, y FROM {PREDICTIONS_SQL}), a AS (SELECT group_id, row_number() OVER (ORDER BY md5(group_id), group_id) AS k FROM g),
b AS (SELECT y, row_number() OVER (ORDER BY md5(concat('shuffle:', group_id)), group_id) AS k FROM g) SELECT a.group_id, b.y AS shuffled FROM a JOIN b USING (k)""")
def shuffled_labels(spark, sf_dir):
    return ranking.shuffled_labels(predictions(spark, sf_dir), "shuffle")


@query("SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY avg(o_totalprice) DESC, o_custkey LIMIT 1")
def best_candidate(spark, sf_dir):
    mean = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("s"))
    return mean.orderBy(F.desc("s"), "o_custkey").limit(1).select("o_custkey")


@query(f"WITH x AS (SELECT 1 AS one, y, p FROM {PREDICTIONS_SQL}), {AUC.format(by='one')} SELECT roc_auc FROM auc")
def overall_auc(spark, sf_dir):
    return metrics.roc_auc(predictions(spark, sf_dir))


@query("""WITH o AS (SELECT o_orderkey FROM orders) SELECT e.event_id, coalesce(o.o_orderkey, (SELECT min(o_orderkey) FROM o)) AS latest FROM events e ASOF LEFT JOIN o ON e.event_id >= o.o_orderkey""")
def asof_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("k"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_orderkey").cast("long").alias("latest"))
    return timeline.latest_by_range(e, o, "k", "latest").withColumnRenamed("k", "event_id")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.l_suppkey AS u, b.l_suppkey AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey),
s AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(node, root) AS (SELECT DISTINCT u, u FROM s UNION SELECT s.v, r.root FROM r JOIN s ON r.node = s.u)
SELECT node, min(root) AS root FROM r GROUP BY node""")
def connected_components(spark, sf_dir):
    from echoline.operators.components import components, stars, tasks_for

    # All suppliers of an order hang on its least one: as many edges as lines, and the components of all pairs.
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    tasks = tasks_for(x)
    return components(stars(x, "l_orderkey", "l_suppkey", tasks), tasks)


@query(f"""SELECT 'no_duplicate_id' AS name, count(*) FILTER (n > 1) = 0 AS passed, count(*) AS coverage, count(*) FILTER (n > 1) AS failures FROM (SELECT clip_id, count(*) AS n FROM {PREDICTIONS_SQL} GROUP BY clip_id)
UNION ALL SELECT 'no_unknown_id', count(*) FILTER (d.doc_id IS NULL) = 0, count(*), count(*) FILTER (d.doc_id IS NULL) FROM {PREDICTIONS_SQL} p LEFT JOIN documents d ON p.clip_id = d.doc_id
UNION ALL SELECT 'no_missing_id', count(*) FILTER (p.clip_id IS NULL) = 0, count(*), count(*) FILTER (p.clip_id IS NULL) FROM documents d LEFT JOIN {PREDICTIONS_SQL} p ON p.clip_id = d.doc_id
UNION ALL SELECT 'finite_probability', count(*) FILTER (p IS NULL OR p NOT BETWEEN 0 AND 1) = 0, count(*), count(*) FILTER (p IS NULL OR p NOT BETWEEN 0 AND 1) FROM {PREDICTIONS_SQL}""")
def prediction_contract(spark, sf_dir):
    return audit.prediction_contract(predictions(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip_id")))


@query(f"""SELECT 'digest' AS name, count(*) FILTER (f > 1) = 0 AS passed, count(*) AS coverage, count(*) FILTER (f > 1) AS failures FROM (SELECT digest, count(DISTINCT fold) AS f FROM {PREDICTIONS_SQL} GROUP BY digest)
UNION ALL SELECT 'group', count(*) FILTER (f > 1) = 0, count(*), count(*) FILTER (f > 1) FROM (SELECT group_id, count(DISTINCT fold) AS f FROM {PREDICTIONS_SQL} GROUP BY group_id)""")
def split_invariants(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return audit.crossing(p, "digest", "digest").unionByName(audit.crossing(p, "group_id", "group"))


# --- signals ----------------------------------------------------------------------------------------------------
M = "list_aggregate(x, 'avg')"
MOMENT = "list_sum(list_transform(x, lambda v: pow(v - m, {k}))) / len(x)"


@query(f"SELECT vec_id, round(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 9) AS rms, round(20 * log10(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) / 32768.0 + 1e-12), 9) AS level FROM {SIGNALS_SQL}")
def signal_level(spark, sf_dir):
    x = signals(spark, sf_dir)
    return rounded(x.select("vec_id", S.rms(F.col("x")).alias("rms"), S.level_dbfs(F.col("x")).alias("level")), "rms", "level")


@query(f"""WITH a AS (SELECT vec_id, x, {M} AS m FROM {SIGNALS_SQL}), b AS (SELECT vec_id, x, {MOMENT.format(k=2)} AS m2, {MOMENT.format(k=3)} AS m3, {MOMENT.format(k=4)} AS m4 FROM a)
SELECT vec_id, round(m3 / pow(sqrt(m2) + 1e-12, 3), 8) AS skewness, round(m4 / pow(sqrt(m2) + 1e-12, 4), 8) AS kurtosis, round(list_max(list_transform(x, lambda v: abs(v))) / (sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) + 1e-12), 8) AS crest FROM b""")
def envelope_features(spark, sf_dir):
    x = F.col("x")
    sd = F.sqrt(S.moment(x, 2)) + F.lit(1e-12)
    out = signals(spark, sf_dir).select("vec_id", (S.moment(x, 3) / F.pow(sd, F.lit(3))).alias("skewness"), (S.moment(x, 4) / F.pow(sd, F.lit(4))).alias("kurtosis"), (F.array_max(F.transform(x, lambda v: F.abs(v))) / (S.rms(x) + F.lit(1e-12))).alias("crest"))
    return rounded(out, "skewness", "kurtosis", "crest", digits=8)


@query(f"""WITH u AS (SELECT vec_id, abs(unnest(x)) AS v FROM {SIGNALS_SQL}) SELECT vec_id, round(quantile_cont(v, 0.5), 12) AS p50, round(quantile_cont(v, 0.75), 12) AS p75, round(quantile_cont(v, 0.9), 12) AS p90, round(quantile_cont(v, 0.99), 12) AS p99 FROM u GROUP BY vec_id""")
def amplitude_percentiles(spark, sf_dir):
    u = signals(spark, sf_dir).select("vec_id", F.explode("x").alias("v")).withColumn("v", F.abs("v"))
    q = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
    return rounded(u.groupBy("vec_id").agg(*[F.expr(f"percentile(v, {x})").alias(n) for n, x in q.items()]), *q, digits=12)


@query(f"SELECT label, i AS pos, round(avg(v), 9) AS mean FROM (SELECT label, unnest(x) AS v, unnest(range(64)) AS i FROM {SIGNALS_SQL}) GROUP BY label, i")
def mean_vector(spark, sf_dir):
    u = signals(spark, sf_dir).select("label", F.posexplode("x").alias("pos", "v"))
    return rounded(u.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.avg("v").alias("mean")), "mean")


@query(f"SELECT i AS pos, round(avg(v), 9) AS mean, round(CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END, 9) AS scale FROM (SELECT unnest(x) AS v, unnest(range(64)) AS i FROM {SIGNALS_SQL}) GROUP BY i")
def standardisation(spark, sf_dir):
    u = signals(spark, sf_dir).select(F.posexplode("x").alias("pos", "v"))
    sd = F.stddev_pop("v")
    return rounded(u.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.avg("v").alias("mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("scale")), "mean", "scale")


@query(f"SELECT vec_id, round(list_reduce(x, lambda a, v: a * 0.8 + v * 0.2), 9) AS ewma FROM {SIGNALS_SQL}")
def ewma(spark, sf_dir):
    return rounded(signals(spark, sf_dir).select("vec_id", S.ewma(F.col("x")).alias("ewma")), "ewma")


@query(f"SELECT vec_id, list_reverse(x)[1] AS first_, x[64] = list_reverse(x)[1] AS same FROM {SIGNALS_SQL}")
def time_reversal(spark, sf_dir):
    r = F.reverse("x")
    return signals(spark, sf_dir).select("vec_id", r[0].alias("first_"), (F.element_at("x", 64) == r[0]).alias("same"))


@query(f"""WITH a AS (SELECT vec_id, x FROM {SIGNALS_SQL}) SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(a.x, lambda v: v * v)) * list_sum(list_transform(b.x, lambda v: v * v))), 9) AS cosine
FROM a JOIN a b ON b.vec_id = a.vec_id + 1""")
def neighbour_cosine(spark, sf_dir):
    x = signals(spark, sf_dir).select("vec_id", "x")
    j = x.toDF("a", "xa").join(x.toDF("b", "xb"), F.col("b") == F.col("a") + 1)
    dot = F.aggregate(F.zip_with("xa", "xb", lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)
    return rounded(j.select("a", "b", (dot / F.sqrt(S.total(F.col("xa"), lambda v: v * v) * S.total(F.col("xb"), lambda v: v * v))).alias("cosine")), "cosine")


@query(f"SELECT vec_id, CASE WHEN len(x) <> 64 THEN 'length' WHEN len(list_filter(x, lambda v: abs(v) > 0.4)) > 0 THEN 'out_of_range' END AS problem, len(list_filter(x, lambda v: abs(v) >= 0.3)) AS full_scale FROM {SIGNALS_SQL}")
def quality_gate(spark, sf_dir):
    x = F.col("x")
    return signals(spark, sf_dir).select("vec_id", S.quality_problem(x, 64, 0.4).alias("problem"), F.size(F.filter(x, lambda v: F.abs(v) >= 0.3)).cast("long").alias("full_scale"))


@query(f"SELECT clip_id, round(1 / (1 + exp(-(2.0 * p - 1.5 * p_b + 0.1))), 12) AS score FROM {PREDICTIONS_SQL}")
def logistic_score(spark, sf_dir):
    z = 2.0 * F.col("p") - 1.5 * F.col("p_b") + 0.1
    return rounded(predictions(spark, sf_dir).select("clip_id", S.logistic(z).alias("score")), "score", digits=12)


@query("SELECT doc_id, CAST('0x' || substr(sha256('stress' || chr(31) || 't2' || chr(31) || doc_id), 1, 15) AS BIGINT) AS seed FROM documents")
def derived_seed(spark, sf_dir):
    h = F.sha2(F.concat_ws("\x1f", F.lit("stress"), F.lit("t2"), F.col("doc_id").cast("string")), 256)
    return table(spark, sf_dir, "documents").select("doc_id", F.conv(F.substring(h, 1, 15), 16, 10).cast("long").alias("seed"))


# --- feature families, numeric kernels without a SQL form -------------------------------------------------------
def _family(name):
    def run(spark, sf_dir):
        return signals(spark, sf_dir).select("vec_id", features.features(name)("x").alias("f")).select("vec_id", "f.*")

    run.__name__ = f"{name}_features"
    return query()(run)


for _name in features.FAMILIES:
    _family(_name)
