"""Relations between tables against brute force and on awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoline.functions import display
from echoline.operators import alignment, overlap, timeline


def test_first_open_incident_is_that_of_brute_force(spark):
    """Overlapping, nested, endless, empty and repeated incidents; repeated samples; null keys and samples."""
    rng = random.Random(3)
    incidents = [(rng.choice("abc"), i, k0 := rng.randrange(60), rng.choice([None] * (rng.random() < 0.1) + [k0 + rng.randrange(-1, 15)])) for i in range(60)]
    incidents += [("a", 90, 5, 9), ("a", 91, 5, 9), (None, 92, 0, None), ("b", 93, None, None)]
    samples = [(s, k) for s in "abcd" for k in range(80)] + [("a", 7), ("a", 7), (None, 3), ("a", None)]

    def first(s, k):
        open_ = [(k0, i) for key, i, k0, k1 in incidents if key is not None and key == s and k0 is not None and k is not None and k0 <= k and (k1 is None or k < k1)]
        return min(open_)[1] if open_ else None

    df = timeline.open_incident(spark.createDataFrame(samples, "session string, k int"), spark.createDataFrame(incidents, "session string, incident int, k0 int, k1 int"), "session")
    assert sorted(map(repr, ((r["session"], r["k"], r["incident"]) for r in df.collect()))) == sorted(repr((s, k, first(s, k))) for s, k in samples)


@pytest.mark.parametrize("ranges", [1, 4, 256])
def test_latest_by_range_is_that_of_brute_force(spark, ranges):
    """One time holds a third of the rows on each side; nulls on both sides; ties take the largest value."""
    rng = random.Random(ranges)
    left = [(i, 50 if i % 3 == 0 else rng.randrange(-20, 200)) for i in range(300)] + [(900, None)]
    right = [(50 if i % 3 == 0 else rng.randrange(0, 150), rng.randrange(1000)) for i in range(90)] + [(None, 5), (60, None)]
    known = sorted((t, v) for t, v in right if t is not None and v is not None)

    def latest(t):
        if t is None:
            return None
        before = [x for x in known if x[0] <= t]
        start = max(v for u, v in known if u == known[0][0])
        return before[-1][1] if before else start

    df = timeline.latest_by_range(spark.createDataFrame(left, "id int, t int"), spark.createDataFrame(right, "t int, v int"), "t", "v", ranges)
    assert sorted((r["id"], r["v"]) for r in df.collect()) == sorted((i, latest(t)) for i, t in left)


def test_latest_by_range_of_empty_sides(spark):
    left, right = spark.createDataFrame([], "t int"), spark.createDataFrame([], "t int, v int")
    assert timeline.latest_by_range(left, right, "t", "v").count() == 0
    assert timeline.latest_by_range(spark.createDataFrame([(1,)], "t int"), right, "t", "v").collect()[0]["v"] is None


@pytest.mark.parametrize("block", [100, 13, 10, 7])
def test_near_pairs_come_once_for_any_number_of_blocks(spark, block):
    rng = random.Random(block)
    x = {i: [rng.gauss(0, 1) for _ in range(3)] for i in range(40)}
    size = lambda v: sum(a * a for a in v) ** 0.5
    want = sorted((a, b) for a in x for b in x if a < b and sum(u * v for u, v in zip(x[a], x[b], strict=True)) / size(x[a]) / size(x[b]) > 0.5)
    got = overlap.near_pairs(spark.createDataFrame(list(x.items()), "id int, x array<double>"), 0.5, block).collect()
    assert sorted((r["a"], r["b"]) for r in got) == want


def test_relations_on_awkward_rows(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (3,), (3,)], "k int")
    pairs = lambda df: sorted(map(repr, map(tuple, df.collect())))
    assert pairs(alignment.difference(a, b, "k")) == sorted(map(repr, [(1, "left"), (None, "left"), (3, "right")]))
    assert pairs(alignment.lacking(a, b, "k")) == sorted(map(repr, [(1,), (1,), (None,)])) and pairs(alignment.covered(a, b, "k")) == ["(2,)"]
    assert [tuple(r) for r in alignment.common({"a": a, "b": b}, "k").collect()] == [(2, ["a", "b"])]
    check = alignment.apart({"a": a, "b": b}, "k").first()
    assert not check["passed"] and check["failures"] == 1 and alignment.apart({"a": a, "b": b.filter("k = 3")}, "k").first()["passed"]
    assert sorted(r["kind"] for r in alignment.inventory({"a": a, "b": b}).collect()) == ["a"] * 4 + ["b"] * 3
    shared = alignment.copies(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, None)], "id int, t string"), F.md5("t"), "id").collect()
    assert [(r["n"], r["first"]) for r in shared] == [(2, 1)]
    with pytest.raises(ValueError):
        alignment.with_files(a.filter("k is not null"), b, "k", check_all=True)
    assert alignment.with_files(a, b.distinct(), "k").count() == 1


@pytest.mark.parametrize("n", [1, 72, 73, 200])
def test_shown_keeps_an_even_stride(spark, n):
    rows = spark.range(n).select(F.lit("s").alias("key"), F.col("id").alias("t"))
    assert sorted(r["t"] for r in display.shown(rows, "key", "t").collect()) == list(range(0, n, -(-n // 72)))


@pytest.mark.parametrize("parts,held", [(1, 1 << 26), (4, 1 << 26), (4, 600)])
def test_near_pairs_hold_for_any_number_of_parts(spark, parts, held):
    """Parts that are dealt by number or by size; zero, null and equal vectors among them."""
    x = np.random.default_rng(5).normal(size=(120, 6))
    x[7], x[30] = 0, x[31]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)]
    got = overlap.near_pairs(spark.createDataFrame(data, "id int, x array<double>"), 0.6, 8, parts, held).collect()
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = {(i, j): u[i] @ u[j] for i in range(120) for j in range(i + 1, 120) if u[i] @ u[j] > 0.6}
    assert {(r["a"], r["b"]) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r["cosine"] - want[r["a"], r["b"]]) < 1e-12 for r in got)


def test_near_pairs_travel_as_the_input_grows(spark):
    """Each vector goes to as many groups at one size as at another; rows of one id are no pair; a null id has none."""
    x = np.random.default_rng(6).normal(size=(96, 4))
    for n in (24, 96):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:n])], "id long, x array<double>")
        plan = overlap.near_pairs(df, 0.9, block=8)
        text = plan._jdf.queryExecution().toString()
        assert f"sequence(0, {overlap.PARTS - 1}" in text or text.count("[0,1,2,3,4,5,6,7]"), text
    again = df.unionByName(df.limit(5)).unionByName(spark.createDataFrame([(None, x[0].tolist())], df.schema))
    want = {(r["a"], r["b"]) for r in plan.collect()}
    got = [(r["a"], r["b"]) for r in overlap.near_pairs(again, 0.9, block=8).collect()]
    assert set(got) == want and len(got) >= len(want) > 0


def test_near_spectra_come_from_no_index_that_may_miss_some(spark):
    from echoline.plans import catalogue

    for name in ("near_spectra", "near_duplicate_folds"):
        assert "sketch" not in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_nearest_segments_need_no_aggregate(spark):
    """Ties go to the least key; a point without a coordinate has null; no rows meet in a shuffle."""
    points = spark.createDataFrame([(1, 0.0, 5.0), (2, 50.0, 0.0), (3, 3.0, 1.0), (4, None, 1.0)], "id long, x double, y double")
    net = spark.createDataFrame([(9, 0.0, 0.0, 10.0, 0.0), (4, 0.0, 10.0, 10.0, 10.0), (7, 20.0, 0.0, 20.0, 0.0)], "k int, x0 double, y0 double, x1 double, y1 double")
    got = display.nearest_segments(points, "x", "y", net, "k")
    assert {(r["id"], r["k"], r["distance"]) for r in got.collect()} == {(1, 4, 5.0), (2, 7, 30.0), (3, 9, 1.0), (4, None, None)}
    assert dict(got.dtypes)["k"] == "int" and display.nearest_segments(points, "x", "y", net.filter("false"), "k").count() == 0
    from echoline.plans import catalogue

    assert "Aggregate" not in catalogue.QUERIES["projected_points"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_views_are_made_a_few_rows_at_a_time(spark):
    """The same views as the function of columns gives, for any number of rows at a time."""
    from echoline.functions import views

    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, rng.normal(size=n).tolist()) for i, n in enumerate((1, 5, 900, 2000, 64))] + [(7, None), (8, []), (9, [float("nan")])], "k int, x array<double>")
    want = {r["k"]: r["v"].asDict() for r in rows.select("k", views.view()("x", F.lit(8000)).alias("v")).collect()}
    for steps in (1, 3, 64):
        got = {r["k"]: {n: v for n, v in r.asDict().items() if n != "k"} for r in views.viewed(rows, "x", 8000.0, steps).collect()}
        assert got == want


def test_weighted_areas_are_those_of_repeated_rows(spark):
    from echoline.operators import metrics

    rng = random.Random(6)
    data = [(k % 3, rng.randint(0, 1), rng.randint(0, 9) / 10, rng.randint(1, 4)) for k in range(200)]
    frame = spark.createDataFrame(data, "k int, y int, p double, n long")
    want = metrics.roc_auc(frame.withColumn("c", F.explode(F.sequence(F.lit(1).cast("long"), "n"))), ["k"]).collect()
    assert sorted(metrics.roc_auc(frame, ["k"], "n").collect()) == sorted(want)
