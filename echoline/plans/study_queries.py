"""Registered queries of studies: the gate, invariants of folds, evaluations, timelines and report tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from echoline.functions import intake
from echoline.operators import evaluation, invariants, metrics, scoring, timeline
from echoline.plans.registry import query, rounded
from echoline.plans.tables import PREDICTIONS_SQL, SIGNALS_SQL, predictions, signals, table, windows, windows_sql
from echoline.sources import manifests

FOLD_SQL = "CASE CAST(substr(source, 4) AS INT) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END"
#: Documents in the role of recordings on disk; the oracle takes the fields themselves, the query parses them from the path.
CLIPS_SQL = f"""(SELECT *, CASE WHEN odd THEN NULL WHEN cls = 'noise' THEN 'NA' ELSE lang END AS material, CASE WHEN odd THEN NULL ELSE source END AS region,
  CASE WHEN odd THEN NULL WHEN cls = 'noise' THEN 'NA' ELSE CAST(n_chars % 40 AS VARCHAR) END AS pressure, CASE WHEN odd THEN NULL WHEN cls = 'noise' OR n_chars % 3 = 0 THEN 'NA' ELSE CAST(n_chars % 7 AS VARCHAR) END AS flow,
  CASE WHEN odd THEN NULL WHEN cls = 'noise' THEN concat('rain-', source, '-dev') ELSE concat(lang, '-', source, '-', n_chars % 40, '-', CASE WHEN n_chars % 3 = 0 THEN 'NA' ELSE CAST(n_chars % 7 AS VARCHAR) END, '-dev') END AS body,
  CASE WHEN odd THEN NULL ELSE CAST(n_chars % 50 AS INT) END AS w0
  FROM (SELECT doc_id AS clip_id, lang, source, n_chars, {FOLD_SQL} AS fold, CASE WHEN doc_id % 5 = 0 THEN 'noise' WHEN doc_id % 5 < 3 THEN 'leak' ELSE 'no_leak' END AS cls, md5(text) AS digest, doc_id % 11 = 0 AS odd FROM documents))"""


def clips(spark, sf_dir):
    c, n = F.col, F.col("n_chars")
    cls = F.when(c("doc_id") % 5 == 0, "noise").when(c("doc_id") % 5 < 3, "leak").otherwise("no_leak")
    flow = F.when(n % 3 == 0, "NA").otherwise((n % 7).cast("string"))
    body = F.when(cls == "noise", F.concat(F.lit("rain-"), "source", F.lit("-dev"))).otherwise(F.concat_ws("-", "lang", "source", (n % 40).cast("string"), flow, F.lit("dev")))
    path = F.when(c("doc_id") % 11 == 0, "odd.wav").otherwise(F.concat(cls, F.lit("/"), body, F.lit("_"), (n % 50).cast("string"), F.lit("-"), (n % 50 + 1).cast("string"), F.lit(".wav")))
    fold = F.element_at(F.array(*map(F.lit, ("train", "validation", "test"))), F.substring("source", 4, 9).cast("int") % 3 + 1)
    rows = table(spark, sf_dir, "documents").select(c("doc_id").alias("clip_id"), fold.alias("fold"), cls.alias("cls"), F.md5("text").alias("digest"), path.alias("path"))
    return invariants.named(rows)


#: Telemetry windows from events: late, early, badly hashed, out of range and abstaining ones among them.
TELEMETRY_SQL = """(SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, epoch(ts) AS end_, epoch(ts) + (event_id % 7) * 0.5 - 0.5 AS received,
  event_id % 13 = 0 AS bad, CASE WHEN event_type <> 'error' THEN value / 100 END AS p, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'clipped' END AS problem FROM events)"""


def telemetry(spark, sf_dir):
    e, c = windows_of(spark, sf_dir), F.col
    digest = F.when(c("event_id") % 13 == 0, "bad").otherwise(F.sha2(c("event_id").cast("string"), 256))
    error = c("event_type") == "error"
    return e.withColumns({"received": c("end_") + (c("event_id") % 7) * 0.5 - 0.5, "digest": digest, "p": F.when(~error, c("value") / 100), "problem": F.when(error & (c("event_id") % 2 == 0), "clipped")})


def windows_of(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumns({"seq": F.row_number().over(w) - 1, "end_": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6})


# --- the gate -----------------------------------------------------------------------------------------------------
@query("""SELECT topology, leak_type, condition, sensor, CASE WHEN topology = 'LO' THEN 'confirmation' WHEN condition IN ('0.47 LPS_N', 'Transient_N') THEN 'validation' ELSE 'train' END AS part
FROM (SELECT unnest(['BR', 'LO']) AS topology), (SELECT unnest(['CC', 'GL', 'LC', 'NL', 'OL']) AS leak_type), (SELECT unnest(['0.18 LPS_N', '0.47 LPS_N', 'ND_NN', 'ND_N', 'Transient_NN', 'Transient_N']) AS condition), (SELECT unnest(['H1', 'H2']) AS sensor)""")
def partition_assignment(spark, sf_dir):
    grid = manifests.recording_grid(spark).filter("subset = 'primary'")
    return grid.select("topology", "leak_type", "condition", "sensor", intake.partition(F.col("topology"), F.col("condition")).alias("part"))


@query("""SELECT * FROM (VALUES ('unique_recording', true, 120, 0), ('sensor_pairs', true, 60, 0), ('population', true, 3, 0), ('partitions', true, 3, 0)) v(name, passed, coverage, failures)""")
def registration_counts(spark, sf_dir):
    grid = manifests.recording_grid(spark).filter("subset = 'primary'")
    return invariants.registration(grid.select("recording_id", F.col("condition_key").alias("group"), "sensor", "label", intake.partition(F.col("topology"), F.col("condition")).alias("partition")))


@query("SELECT event_id, value IS NOT NULL AND NOT isnan(value) AND value / 100 BETWEEN 0 AND 1 AS ok FROM events")
def finite_probability(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", intake.probability(F.col("value") / 100).alias("ok"))


@query(f"""SELECT event_id, CASE WHEN bad THEN 'digest' WHEN p > 1 OR p < 0 THEN 'score' WHEN p IS NULL AND problem IS NULL THEN 'abstention without a reason'
  WHEN event_id % 7 = 0 THEN 'future' WHEN event_id % 7 = 6 THEN 'stale' END AS reason FROM {TELEMETRY_SQL}""")
def validity_reason(spark, sf_dir):
    c = F.col
    reason = F.coalesce(intake.malformed(c("seq"), c("end_"), c("received"), c("digest"), c("p"), c("problem")), intake.untimely(c("end_"), c("received")))
    return telemetry(spark, sf_dir).select("event_id", reason.alias("reason"))


@query(f"""WITH s AS (SELECT user_id, event_id, seq - lag(seq) OVER w AS dq, end_ - lag(end_) OVER w AS de FROM {TELEMETRY_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT user_id, count(*) FILTER (abs(de - dq) > 0.01) AS off FROM s GROUP BY user_id""")
def cadence_check(spark, sf_dir):
    from pyspark.sql import Window

    w, c = Window.partitionBy("user_id").orderBy("seq"), F.col
    off = intake.off_cadence(c("end_"), F.lag("end_").over(w), c("seq"), F.lag("seq").over(w))
    return telemetry(spark, sf_dir).select("user_id", off.alias("off")).groupBy("user_id").agg(F.count_if("off").alias("off"))


@query("WITH b AS (SELECT user_id, avg(value) AS baseline FROM events GROUP BY user_id) SELECT e.event_id FROM events e JOIN b ON e.user_id = b.user_id WHERE e.value > 1.6 * b.baseline")
def anomaly_predicate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    b = e.groupBy("user_id").agg(F.avg("value").alias("baseline"))
    return e.join(b, "user_id").filter(intake.anomalous(F.col("value"), F.col("baseline"))).select("event_id")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'ended' WHEN value > 2 OR event_id % 10 = 0 THEN 'degraded' ELSE 'ok' END AS health FROM events""")
def public_projection(spark, sf_dir):
    c = F.col
    health = intake.public_health(c("event_type") == "error", F.lit("ok"), F.lit(None).cast("double"), F.lit(0.0), c("value"), c("event_id") % 10 != 0)
    return table(spark, sf_dir, "events").select("event_id", health.alias("health"))


@query("""SELECT event_id, value IS NOT NULL AND event_id % 4 <> 1 AS sound FROM events""")
def incident_validity(spark, sf_dir):
    c = F.col
    end = F.when(c("event_id") % 4 == 1, float("nan")).when(c("event_id") % 4 == 2, 5.0)
    return table(spark, sf_dir, "events").select("event_id", intake.incident_valid(c("value"), F.lit(1.0), F.lit(0.0), end).alias("sound"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Armed · waiting 30 s' WHEN 1 THEN 'Dispatching' WHEN 2 THEN 'Sent · 10:00' WHEN 3 THEN 'Notification failed · Telegram delivery unavailable'
  WHEN 4 THEN 'Delivery unconfirmed · check Telegram before any new alert' ELSE 'Not dispatched' END AS told FROM orders""")
def delivery_texts(spark, sf_dir):
    k = (F.col("o_orderkey") % 6).cast("int")
    kind = F.get(F.array(*map(F.lit, ("sent", "dispatching", "sent", "failed", "unknown", "not_dispatched"))), k)
    told = intake.delivery_text(F.when(k == 0, "ANOMALY_PENDING").otherwise("CONFIRMED"), kind, F.lit("10:00"))
    return table(spark, sf_dir, "orders").select("o_orderkey", told.alias("told"))


@query(r"""SELECT o_orderkey, concat('🚨 Alert', chr(10), chr(10), 'Persistent abnormal signal detected for 30 seconds.', chr(10), 'Strongest response: Sensor ', o_custkey % 3, chr(10), 'Zone: ', o_orderpriority, chr(10),
  'Action: inspection recommended.', chr(10), 'Detected: 10:00', chr(10), chr(10), 'Source: ', CASE WHEN o_orderstatus = 'P' THEN 'injected test incident' ELSE o_orderstatus END, CASE WHEN o_orderkey % 2 = 0 THEN concat(chr(10), 'Verification: seen') ELSE '' END) AS told FROM orders""")
def alert_texts(spark, sf_dir):
    c = F.col
    source = F.when(c("o_orderstatus") == "P", "injected_test").otherwise(c("o_orderstatus"))
    told = intake.alert_text(F.lit(30), c("o_custkey") % 3, c("o_orderpriority"), F.lit("10:00"), source, F.when(c("o_orderkey") % 2 == 0, "seen"))
    return table(spark, sf_dir, "orders").select("o_orderkey", told.alias("told"))


@query("SELECT vec_id, concat(chr(10), 'Measured normalized-amplitude statistics (C1; six significant digits): ', " + ", '; ', ".join(f"format('{n}={{:.6g}}', x[{i + 1}])" for i, n in enumerate(intake.AMPLITUDE_NAMES)) + f") AS told FROM {SIGNALS_SQL}")
def amplitude_texts(spark, sf_dir):
    return signals(spark, sf_dir).select("vec_id", intake.amplitude_text(F.slice("x", 1, 9)).alias("told"))


@query(f"SELECT vec_id, len(list_filter(x, lambda v: v * 4 <= -1 OR v * 4 >= 32767 / 32768)) AS n FROM {SIGNALS_SQL}")
def full_scale_samples(spark, sf_dir):
    return signals(spark, sf_dir).select("vec_id", intake.full_scale(F.transform("x", lambda v: v * 4)).alias("n"))


# --- invariants ---------------------------------------------------------------------------------------------------
@query(f"SELECT clip_id, material, region, pressure, flow, body, w0 FROM {CLIPS_SQL}")
def filename_parse(spark, sf_dir):
    return clips(spark, sf_dir).select("clip_id", "material", "region", "pressure", "flow", "body", "w0")


@query(f"""WITH c AS {CLIPS_SQL}, k AS (SELECT 'exact_duplicate' AS name, digest AS k, fold FROM c WHERE digest IS NOT NULL UNION ALL SELECT 'session', concat(cls, '|', body), fold FROM c WHERE body IS NOT NULL
  UNION ALL SELECT 'leak_condition', concat(pressure, '|', flow), fold FROM c WHERE cls = 'leak' AND pressure <> 'NA' AND flow <> 'NA' UNION ALL SELECT 'quiet_condition', concat(material, '|', region), fold FROM c WHERE cls = 'no_leak' AND body IS NOT NULL),
g AS (SELECT name, k, count(*) AS n, count(DISTINCT fold) > 1 AS bad FROM k GROUP BY ALL)
SELECT name, count(*) FILTER (bad) = 0 AS passed, CAST(sum(n) AS BIGINT) AS coverage, count(*) FILTER (bad) AS failures FROM g GROUP BY name""")
def fold_invariants(spark, sf_dir):
    return invariants.fold_invariants(clips(spark, sf_dir))


@query("""SELECT count(*) AS n, count(*) FILTER (c.c_custkey IS NULL) AS only_left, count(*) FILTER (o.k IS NULL) AS only_right FROM (SELECT DISTINCT o_custkey AS k FROM orders) o FULL OUTER JOIN customer c ON o.k = c.c_custkey""")
def set_equality(spark, sf_dir):
    return invariants.same_keys(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k"), table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k"), "k")


@query("""SELECT k, list_sort(list(t)) AS found_in FROM (SELECT c_custkey AS k, 0 AS t FROM customer UNION SELECT s_suppkey, 1 FROM supplier UNION SELECT p_partkey, 2 FROM part) GROUP BY k HAVING count(*) < 3""")
def id_equality(spark, sf_dir):
    names = (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))
    return invariants.same_on_all([table(spark, sf_dir, t).withColumnRenamed(k, "k") for t, k in names], "k")


@query(f"WITH g AS (SELECT y, group_id, min(clip_id) AS clip_id FROM {PREDICTIONS_SQL} GROUP BY y, group_id) SELECT y, group_id, clip_id FROM g QUALIFY row_number() OVER (PARTITION BY y ORDER BY clip_id) <= 3")
def first_distinct_groups(spark, sf_dir):
    return invariants.first_groups(predictions(spark, sf_dir), 3)


@query(f"""WITH d AS (SELECT clip_id, group_id, y, (dense_rank() OVER (PARTITION BY y ORDER BY md5(concat('seed:', group_id)), group_id) - 1) % 3 AS cv_fold FROM {PREDICTIONS_SQL}), n AS (SELECT count(*) AS clips, count(DISTINCT group_id) AS groups_, count(DISTINCT cv_fold) AS folds FROM d)
SELECT 'held_out_once' AS name, true AS passed, clips AS coverage, 0 AS failures FROM n UNION ALL SELECT 'group_in_one_fold', true, groups_, 0 FROM n UNION ALL SELECT 'group_of_one_class', true, groups_, 0 FROM n
UNION ALL SELECT 'both_classes', true, folds, 0 FROM n UNION ALL SELECT 'all_folds', folds = 3, folds, abs(folds - 3) FROM n""")
def fold_validation(spark, sf_dir):
    from echoline.operators import ranking

    rows = predictions(spark, sf_dir)
    dealt = rows.join(ranking.grouped_folds(rows, 3, "seed").select("group_id", "cv_fold"), "group_id").select("clip_id", "cv_fold")
    return invariants.fold_partition(rows, dealt)


# --- evaluation ---------------------------------------------------------------------------------------------------
@query(f"SELECT clip_id, y, p FROM {PREDICTIONS_SQL} WHERE fold = 'validation'")
def fold_filter(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return evaluation.aligned(p.drop("p"), p, "validation").select("clip_id", "y", "p")


@query(f"SELECT clip_id, CAST(p >= 0.5 AS INT) AS decision FROM {PREDICTIONS_SQL}")
def threshold_decision(spark, sf_dir):
    return evaluation.decided(predictions(spark, sf_dir), 0.5).select("clip_id", "decision")


@query("SELECT l_returnflag, count(l_extendedprice) AS n, quantile_cont(l_extendedprice, 0.5) AS median_ms, quantile_cont(l_extendedprice, 0.95) AS p95_ms, min(l_extendedprice) AS min_ms, max(l_extendedprice) AS max_ms FROM lineitem GROUP BY l_returnflag")
def latency_summary(spark, sf_dir):
    return evaluation.latency_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")


AUDIT_SQL = f"(SELECT fold, clip_id, CASE WHEN clip_id % 7 = 0 THEN 'timeout' END AS error, clip_id % 7 = 1 AS abstained, clip_id % 7 > 1 AS format_valid, clip_id % 7 > 3 AS correct_band, CASE WHEN clip_id % 7 > 1 THEN toxic = 1 END AS disagrees FROM {PREDICTIONS_SQL})"


@query(f"""WITH c AS (SELECT fold, count(*) AS n_attempted, count(DISTINCT clip_id) AS n_clips, count(error) AS n_errors, count(*) FILTER (abstained) AS n_abstentions, count(*) FILTER (format_valid) AS n_valid_format,
  count(*) FILTER (correct_band) AS n_correct_band, count(disagrees) AS n_comparable, count(*) FILTER (disagrees) AS n_disagreements FROM {AUDIT_SQL} GROUP BY fold)
SELECT *, n_valid_format / n_attempted AS valid_format_rate, n_correct_band / n_attempted AS correct_band_rate, n_valid_format - n_correct_band AS n_wrong_band, n_attempted - n_valid_format AS n_no_usable_text,
  n_disagreements / n_comparable AS disagreement_rate, n_attempted - n_comparable AS n_not_comparable FROM c""")
def fold_audit(spark, sf_dir):
    k = F.col("clip_id") % 7
    rows = predictions(spark, sf_dir).select("fold", "clip_id", F.when(k == 0, "timeout").alias("error"), (k == 1).alias("abstained"), (k > 1).alias("format_valid"), (k > 3).alias("correct_band"), F.when(k > 1, F.col("toxic") == 1).alias("disagrees"))
    return evaluation.text_audit(rows)


@query(f"""WITH c AS (SELECT fold, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 0 AND p < 0.5) AS tn, count(*) FILTER (y = 1 AND p < 0.5) AS fn FROM {PREDICTIONS_SQL} GROUP BY fold)
SELECT fold, tp + fn AS leaks, tn + fp AS quiet, fp, fn, CASE WHEN tp + fp = 0 THEN '—' ELSE printf('%.1f %%', 100.0 * (tp / (tp + fp))) END AS precision, CASE WHEN 2 * tp + fp + fn = 0 THEN '—' ELSE printf('%.1f %%', 100.0 * (2 * tp / (2 * tp + fp + fn))) END AS f1,
  CASE WHEN tp + fn = 0 THEN '—' ELSE printf('%.1f %%', 100.0 * (tp / (tp + fn))) END AS recall, CASE WHEN fp + tn = 0 THEN '—' ELSE printf('%.1f %%', 100.0 * (fp / (fp + tn))) END AS fpr, CASE WHEN tp + fn = 0 THEN '—' ELSE printf('%.1f %%', 100.0 * (fn / (tp + fn))) END AS missed FROM c""")
def decision_table(spark, sf_dir):
    return evaluation.decision_table(metrics.metric_block(predictions(spark, sf_dir), 0.5, ["fold"]), ["fold"])


@query()
def run_evaluation(spark, sf_dir):
    return evaluation.evaluate_run(predictions(spark, sf_dir))


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_name < b.r_name")
def run_pairs(spark, sf_dir):
    return evaluation.run_pairs(table(spark, sf_dir, "region"), "r_name")


@query(f"""WITH v AS (SELECT lang, CASE WHEN avg(p - p_b) > 0 THEN 'A' ELSE 'B' END AS verdict FROM {PREDICTIONS_SQL} GROUP BY lang), g AS (SELECT verdict, count(*) AS n, list_sort(list(lang)) AS l FROM v GROUP BY verdict)
SELECT verdict, n, CASE WHEN n = 1 THEN l[1] ELSE concat(array_to_string(l[1:n - 1], ', '), ' and ', l[n]) END AS names FROM g""")
def verdict_groups(spark, sf_dir):
    v = predictions(spark, sf_dir).groupBy("lang").agg(F.when(F.avg(F.col("p") - F.col("p_b")) > 0, "A").otherwise("B").alias("verdict"))
    return evaluation.by_verdict(v, "lang", "verdict")


@query(f"""WITH b AS (SELECT x, vec_id FROM {SIGNALS_SQL}), d AS (SELECT vec_id, list_transform(x, lambda v: abs(v - round(v, 1))) AS g FROM b)
SELECT vec_id, true AS same_shape, list_max(g) = 0 AS exact, len(list_filter(g, lambda v: v <> 0)) AS n_different, list_max(g) AS max_abs, round(list_sum(g) / len(g), 9) AS mean_abs FROM d""")
def array_differences(spark, sf_dir):
    d = evaluation.array_difference(F.col("x"), F.transform("x", lambda v: F.round(v, 1)))
    return rounded(signals(spark, sf_dir).select("vec_id", d.alias("d")).select("vec_id", "d.same_shape", "d.exact", "d.n_different", "d.max_abs", "d.mean_abs"), "mean_abs")


def level_scorer():
    """Scores a batch of signals by their level alone."""
    return lambda x: 1 / (1 + np.exp(-np.sqrt((x * x).mean(axis=1))))


@query(f"""WITH s AS (SELECT vec_id AS clip_id, 1 / (1 + exp(-sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)))) AS p FROM {SIGNALS_SQL}),
r AS (SELECT clip_id, size, dir, p FROM s, (VALUES (1), (2), (4)) a(size), (VALUES ('forward'), ('reversed')) b(dir)), c AS (SELECT clip_id, max(p) - min(p) AS spread, max(p) >= 0.6 AS hi, min(p) >= 0.6 AS lo, count(*) AS n FROM r GROUP BY clip_id)
SELECT count(*) AS n, count(*) FILTER (spread > 1e-6) AS beyond, count(*) FILTER (hi <> lo) AS flips, round(max(spread), 9) AS largest, (SELECT clip_id FROM c ORDER BY round(spread, 9) DESC, clip_id LIMIT 1) AS worst, count(*) FILTER (n <> 6) AS faulty FROM c""")
def batch_invariance(spark, sf_dir):
    clips = signals(spark, sf_dir).select(F.col("vec_id").alias("clip_id"), F.col("x").alias("samples"))
    routes = scoring.by_routes(clips, level_scorer)
    return rounded(evaluation.batch_invariance(routes, 2 * len(evaluation.BATCH_SIZES), 0.6), "largest")


# --- timelines ----------------------------------------------------------------------------------------------------
@query(f"""WITH m AS (SELECT session, seq * 3 + 2 AS time, p FROM {windows_sql()}), c AS (SELECT session, seq AS time FROM {windows_sql()}), f AS (SELECT session, arg_min(p, time) AS first_ FROM m GROUP BY session)
SELECT c.session, c.time, coalesce(m.p, f.first_) AS p FROM c ASOF LEFT JOIN m ON c.session = m.session AND c.time >= m.time JOIN f ON f.session = c.session""")
def latest_ring(spark, sf_dir):
    w = windows(spark, sf_dir)
    return timeline.latest_at(w.select("session", F.col("seq").alias("time")), w.select("session", (F.col("seq") * 3 + 2).alias("time"), "p"), "session", "p")


@query(f"""WITH w AS (SELECT *, coalesce(seq - lag(seq) OVER s > 1, false) OR p IS NULL AS brk FROM {windows_sql(True)} r WINDOW s AS (PARTITION BY session ORDER BY seq)), i AS (SELECT *, sum(CAST(brk AS INT)) OVER (PARTITION BY session ORDER BY seq) AS run FROM w)
SELECT session, seq, count(p) OVER h AS n, round(coalesce(sum(p) OVER h, 0), 9) AS total FROM i WINDOW h AS (PARTITION BY session, run ORDER BY seq ROWS 63 PRECEDING)""")
def kept_history(spark, sf_dir):
    h = timeline.kept_history(windows(spark, sf_dir, True), "p")
    total = F.aggregate("history", F.lit(0.0), lambda acc, v: acc + v)
    return rounded(h.select("session", "seq", F.size("history").cast("long").alias("n"), total.alias("total")), "total")


@query(f"SELECT session, max(seq) AS k, arg_max(p, seq) AS p FROM {windows_sql()} GROUP BY session")
def latest_reading(spark, sf_dir):
    return timeline.latest_reading(windows(spark, sf_dir).withColumnRenamed("seq", "k"), "session", "p")


@query(f"SELECT session, seq AS k, p, seq % 40 = 0 AS tick FROM {windows_sql()} QUALIFY seq > max(seq) OVER (PARTITION BY session) - 240")
def chart_window(spark, sf_dir):
    return timeline.chart(windows(spark, sf_dir).withColumnRenamed("seq", "k"), "session")


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 50")
def last_fifty(spark, sf_dir):
    return timeline.newest(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 50)


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10")
def newest_per_session(spark, sf_dir):
    return timeline.newest(table(spark, sf_dir, "events").select("user_id", "event_id"), "event_id", 10, ["user_id"])


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def first_pending(spark, sf_dir):
    return timeline.first_pending(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "P", "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query(f"""WITH s AS (SELECT session, seq AS k FROM {windows_sql()}), i AS (SELECT session, seq AS incident, seq AS k0, CASE WHEN seq % 3 <> 0 THEN seq + 5 END AS k1 FROM {windows_sql()} WHERE seq % 8 = 1)
SELECT s.session, s.k, arg_min(i.incident, i.k0) AS incident FROM s LEFT JOIN i ON s.session = i.session AND s.k >= i.k0 AND (i.k1 IS NULL OR s.k < i.k1) GROUP BY s.session, s.k""")
def open_incidents(spark, sf_dir):
    w = windows(spark, sf_dir)
    i = w.filter("seq % 8 = 1").select("session", F.col("seq").alias("incident"), F.col("seq").alias("k0"), F.when(F.col("seq") % 3 != 0, F.col("seq") + 5).alias("k1"))
    return timeline.open_incident(w.select("session", F.col("seq").alias("k")), i, "session")


# --- ids ----------------------------------------------------------------------------------------------------------
@query("SELECT doc_id, concat('clip_', sha256(concat('clip', chr(0), CAST(doc_id AS VARCHAR)))) AS id FROM documents")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", manifests.stable_id("clip", F.col("doc_id")).alias("id"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return evaluation.duplicates(table(spark, sf_dir, "events"), "user_id")
