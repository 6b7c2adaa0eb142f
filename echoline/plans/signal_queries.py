"""Registered queries of near copies among spectra, exactly equal aligned windows, and pooled spectrograms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.functions import series, views
from echoline.operators import invariants, nearindex, overlap, scoring
from echoline.plans.domain_queries import RECORDINGS_SQL, recordings
from echoline.plans.registry import query, rounded
from echoline.plans.tables import SIGNALS_SQL, signals

#: Spectra of the test signals are hardly alike: few pairs reach 0.45, where an index would compare more than all pairs and miss some.
NEAR = 0.45
FOLDS = ("train", "validation", "test")

#: Log-spectra of the test signals: 64 samples between 8 zeros on either side, frames of 16 that overlap by half, nine frequencies.
SPECTRA_SQL = f"""s AS (SELECT vec_id, list_concat(list_concat([0.0::DOUBLE, 0, 0, 0, 0, 0, 0, 0], x), [0.0::DOUBLE, 0, 0, 0, 0, 0, 0, 0]) AS w FROM {SIGNALS_SQL}),
w AS (SELECT vec_id, unnest(w) AS v, unnest(range(80)) AS i FROM s),
c AS (SELECT vec_id, t, k, sum(v * (0.5 - 0.5 * cos(2 * pi() * (i - t * 8) / 16)) * cos(2 * pi() * k * (i - t * 8) / 16)) AS re, sum(v * (0.5 - 0.5 * cos(2 * pi() * (i - t * 8) / 16)) * sin(2 * pi() * k * (i - t * 8) / 16)) AS im
  FROM w, range(9) a(t), range(9) b(k) WHERE i >= t * 8 AND i < t * 8 + 16 GROUP BY ALL),
l AS (SELECT vec_id, k * 9 + t AS i, ln(1 + sqrt(re * re + im * im) / 8) AS v FROM c),
m AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY i) AS v FROM l), r AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM m),
u AS (SELECT vec_id, list(v ORDER BY i) AS u, sqrt(sum(v * v)) AS n FROM r GROUP BY vec_id),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.u, b.u) / (a.n * b.n) AS cosine FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.u, b.u) / (a.n * b.n) > {NEAR})"""


def spectra(spark, sf_dir) -> DataFrame:
    rows = signals(spark, sf_dir).select(F.col("vec_id").alias("id"), series.log_spectrum(64, 16)("x").alias("x"))
    return nearindex.double_centred(rows)


@query(f"WITH {SPECTRA_SQL} SELECT a, b, round(cosine, 6) AS cosine FROM p")
def near_spectra(spark, sf_dir):
    return rounded(overlap.near_pairs(spectra(spark, sf_dir), NEAR), "cosine", digits=6)


@query(f"""WITH {SPECTRA_SQL}, f AS (SELECT vec_id, vec_id % 3 AS fold, x FROM {SIGNALS_SQL}), d AS (SELECT count(*) AS n, count(DISTINCT fold) > 1 AS bad FROM f GROUP BY x)
SELECT 'exact_duplicate' AS name, count(*) FILTER (bad) = 0 AS passed, CAST(sum(n) AS BIGINT) AS coverage, count(*) FILTER (bad) AS failures FROM d
UNION ALL SELECT 'near_duplicate', count(*) FILTER (a % 3 <> b % 3) = 0, (SELECT count(*) FROM f), count(*) FILTER (a % 3 <> b % 3) FROM p""")
def near_duplicate_folds(spark, sf_dir):
    fold = F.element_at(F.array(*map(F.lit, FOLDS)), (F.col("vec_id") % 3 + 1).cast("int"))
    none = F.lit(None).cast("string")
    clips = signals(spark, sf_dir).select(
        F.col("vec_id").alias("clip_id"), fold.alias("fold"), F.lit("noise").alias("cls"), series.signal_digest("x").alias("digest"), *[none.alias(c) for c in ("body", "material", "region", "pressure", "flow")]
    )
    pairs = overlap.near_pairs(spectra(spark, sf_dir), NEAR)
    return invariants.fold_invariants(clips, pairs).filter(F.col("name").isin("exact_duplicate", "near_duplicate"))


#: Every other recording four times as loud: its windows equal their clips but for gain.
LOUD_SQL = f"(SELECT record, CASE WHEN record % 2 = 1 THEN list_transform(samples, lambda v: v * 4) ELSE samples END AS samples FROM {RECORDINGS_SQL})"
_UNIT = "(SELECT {k}, list_transform({x}, lambda v: round((v - list_avg({x})) / n, 9)) AS u FROM (SELECT *, sqrt(list_sum(list_transform({x}, lambda v: (v - list_avg({x})) * (v - list_avg({x}))))) AS n FROM {t}) WHERE n > 0)"


@query(f"""WITH c AS (SELECT vec_id AS clip, x FROM {SIGNALS_SQL}), w AS (SELECT record, o * 64 AS o, samples[o * 64 + 1:o * 64 + 64] AS x FROM (SELECT record, samples, unnest(range(len(samples) // 64)) AS o FROM {LOUD_SQL})),
cu AS {_UNIT.format(k='clip', x='x', t='c')}, wu AS {_UNIT.format(k='record, o', x='x', t='w')}
SELECT clip, record, o AS "offset", 'decoded_float64' AS kind FROM c JOIN w USING (x) UNION ALL SELECT clip, record, o, 'centered_unit_float64' FROM cu JOIN wu USING (u)""")
def aligned_matches(spark, sf_dir):
    clips = signals(spark, sf_dir).select(F.col("vec_id").alias("clip"), F.col("x").alias("samples"))
    loud = F.when(F.col("record") % 2 == 1, F.transform("samples", lambda v: v * 4)).otherwise(F.col("samples"))
    return overlap.aligned_matches(clips, recordings(spark, sf_dir).select("record", loud.alias("samples")), 64)


@query(f"""WITH s AS (SELECT record, unnest(samples) AS v, unnest(range(len(samples))) AS i, len(samples) AS n FROM {RECORDINGS_SQL}), h AS (SELECT record, i, n, v * (0.5 - 0.5 * cos(2 * pi() * i / n)) AS v FROM s),
f AS (SELECT DISTINCT n, unnest(range(n // 2 + 1)) AS k FROM (SELECT DISTINCT n FROM s)), d AS (SELECT record, n, k, sum(v * cos(2 * pi() * ((k * i) % n) / n)) AS re, sum(v * sin(2 * pi() * ((k * i) % n) / n)) AS im FROM h JOIN f USING (n) GROUP BY ALL),
p AS (SELECT record, n, k, (re * re + im * im) / pow(n / 2.0, 2) AS p FROM d), g AS (SELECT *, n // 2 + 1 AS m, CASE WHEN n // 2 + 1 <= 256 THEN k ELSE greatest(k - 1, 0) END AS g FROM p)
SELECT record, g AS cell, round(avg(k * 16000.0 / n), 6) AS frequency_hz, round(10 * log10(greatest(avg(p), 1e-12)), 2) AS power_db FROM g GROUP BY record, g""")
def spectrogram_pooling(spark, sf_dir):
    v = views.viewed(recordings(spark, sf_dir), "samples", 16000.0)
    cells = v.select("record", F.posexplode(F.arrays_zip("frequencies_hz", "power_db")).alias("cell", "c"))
    return cells.select("record", F.col("cell").cast("long").alias("cell"), F.round("c.frequencies_hz", 6).alias("frequency_hz"), F.get("c.power_db", F.lit(0)).alias("power_db"))



def measures():
    """Mean, level and peak of each window, and a score from the level."""
    measure = lambda x: np.stack([x.mean(axis=1), np.sqrt((x * x).mean(axis=1)), np.abs(x).max(axis=1)], axis=1)
    return measure, lambda m: 1 / (1 + np.exp(-m[:, 1]))


@query(f"""WITH w AS (SELECT record, o, samples[o * 64 + 1:o * 64 + 64] AS x FROM (SELECT record, samples, unnest(range(8)) AS o FROM {RECORDINGS_SQL} WHERE len(samples) = 512)),
m AS (SELECT record, o, list_avg(x) AS mean, sqrt(list_sum(list_transform(x, lambda v: v * v)) / 64) AS level, list_max(list_transform(x, lambda v: abs(v))) AS peak FROM w)
SELECT record, CAST(o AS BIGINT) AS window_, round(mean, 9) AS mean, round(level, 9) AS level, round(peak, 9) AS peak, round(1 / (1 + exp(-level)), 9) AS p FROM m""")
def recording_matrix(spark, sf_dir):
    made = scoring.recording_matrix(recordings(spark, sf_dir), measures, "record", 8, 64).filter("problem is null")
    rows = made.select("record", F.posexplode("matrix").alias("w", "m"))
    cells = {n: F.get("m", F.lit(i)).alias(n) for i, n in enumerate(("mean", "level", "peak", "p"))}
    return rounded(rows.select("record", F.col("w").cast("long").alias("window_"), *cells.values()), *cells)
