import numpy as np
import pytest

from echoline.plans import catalogue as q
from echoline.plans.domain_queries import recordings
from echoline.plans.tables import signals
from tests.oracle import expected, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_oracle(spark, name):
    got = q.QUERIES[name](spark, SF).toPandas()
    want = expected(q.ORACLES[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    got, want = rows(got), rows(want)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b) if all(isinstance(x, float) for x in a) else repr(a) == repr(b) or a == b


def test_queries_without_sql_run(spark):
    for name in sorted(set(q.QUERIES) - set(q.ORACLES)):
        assert q.QUERIES[name](spark, SF).count() > 0


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_sliding_overlap_takes_whole_signals(spark):
    """Every twentieth signal with all its samples, against brute force."""
    x = {r["vec_id"]: np.array(r["x"]) for r in signals(spark, SF).collect()}
    records = {str(r["record"]): np.array(r["samples"]) for r in recordings(spark, SF).collect()}
    got = {(r["query"], r["record"]): r for r in q.QUERIES["sliding_overlap"](spark, SF).collect()}
    assert set(got) == {(str(i), r) for i in x if i % 20 == 0 for r in records}
    for (i, record), r in got.items():
        a, w = x[int(i)], np.lib.stride_tricks.sliding_window_view(records[record], len(x[int(i)]))
        a, w = a - a.mean(), w - w.mean(axis=1, keepdims=True)
        c = w @ a / np.sqrt((w * w).sum(axis=1) * (a @ a))
        assert len(a) == 64 and r["offset"] == np.abs(c).argmax() and r["correlation"] == pytest.approx(c[r["offset"]], abs=2e-6)


def test_components_come_from_every_line(spark, tmp_path):
    """Orders of any number of lines, and of lines in any place, tie their suppliers; against brute force."""
    orders = [[3, 9], [9, 4, 12], [5], [7, 7], [20, 21, 22, 23, 24, 25, 26], [26, 30], [40, 41], [41, 2]]
    data = [(i, s, n + 1) for i, o in enumerate(orders) for n, s in enumerate(o)] + [(None, 50, 1), (None, 51, 2), (90, None, 1), (90, 3, 2)]
    spark.createDataFrame(data, "l_orderkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    root = {s: s for o in orders for s in o}
    for _ in root:
        for o in orders:
            least = min(root[s] for s in o)
            root |= dict.fromkeys(o, least)
    tied = {s for o in orders if len(set(o)) > 1 for s in o}
    got = q.QUERIES["connected_components"](spark, str(tmp_path)).collect()
    assert {(r["node"], r["root"]) for r in got} == {(s, root[s]) for s in tied} and len(got) == len(tied)


def test_tasks_of_components_grow_with_the_rows(spark, tmp_path, monkeypatch):
    """Edges become distinct in tasks of a bounded number of rows, which aren't merged for being small; once, not again for the other way."""
    from echoline.operators import components as c

    spark.createDataFrame([(i // 3, i % 50) for i in range(600)], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    kept, store = [], c.stored
    monkeypatch.setattr(c, "ROWS", 20, raising=False)
    monkeypatch.setattr(c, "stored", lambda df, tag: kept.append((tag, df.rdd.getNumPartitions(), df.count())) or store(df, tag))
    got = q.QUERIES["connected_components"](spark, str(tmp_path)).collect()
    links = next(k for k in kept if k[0] == "links")
    assert {(r["node"], r["root"]) for r in got} == {(s, 0) for s in range(50)} and links[1] == 30
    assert links[2] == len({(min(o), s) for k in range(200) for o in [[i % 50 for i in range(3 * k, 3 * k + 3)]] for s in o if s > min(o)})


@pytest.mark.parametrize("tasks", [None, 1, 7])
def test_components_of_repeated_reversed_and_null_edges(spark, tasks):
    from echoline.operators.components import components

    edges = [(1, 2), (2, 1), (1, 2), (3, 2), (9, 8), (7, 7), (None, 5), (6, None), (8, 4)]
    got = components(spark.createDataFrame(edges, "a int, b int"), tasks).collect()
    assert sorted((r["node"], r["root"]) for r in got) == [(1, 1), (2, 1), (3, 1), (4, 4), (7, 7), (8, 4), (9, 4)]
