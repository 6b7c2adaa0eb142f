"""Buckets of many unlike texts, filters that are too small, and rows that only other columns tell apart."""

from collections import Counter

import numpy as np
import pytest

from echoline.llm import decontaminate, mixing, nearcopies, simhash


def test_leaders_of_a_hot_key_meet_by_parts(spark):
    """300 unlike texts that share two keys, and 40 near copies of some: every near pair is linked, no other."""
    rng = np.random.default_rng(3)
    sketch = lambda: np.sort(rng.choice(1 << 32, 256, replace=False).astype(np.uint32))
    rows, want = [], set()
    for i in range(300):
        own = sketch()
        rows.append((i, i, [1, 2, *(1000 * i + k for k in range(10))], own))
        if i < 40:
            other = np.unique(np.concatenate([own[:240], sketch()[:16]]))
            rows.append((1000 + i, 1000 + i, [1, 2, *(1000 * (5000 + i) + k for k in range(10))], np.sort(other)))
            if nearcopies.similarity(own, np.sort(other)) >= nearcopies.ALIKE:
                want.add((i, 1000 + i))
    table = [(t, f, k, bytearray(s.tobytes())) for t, f, k, s in rows]
    prints = spark.createDataFrame(table, "th long, fp long, keys array<long>, sketch binary")
    assert len(want) > 20
    for limit in (50, 4096):
        got = {tuple(sorted((r["a"], r["b"]))) for r in nearcopies.near_links(prints, limit).collect()}
        assert got == want


def test_leaders_by_index_equal_a_loop():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.choice(1 << 20, n).astype(np.uint32)) for n in (3, 40, 256, 256, 1)]
    leaders, plain = nearcopies.Leaders(), []
    for i in range(300):
        b = base[rng.integers(len(base))]
        own = np.unique(np.concatenate([b[rng.random(len(b)) < rng.choice([0.8, 0.95, 1.0])], rng.choice(1 << 20, rng.integers(0, 12)).astype(np.uint32)]))[:256]
        if not len(own):
            continue
        want = [name for name, other in plain if nearcopies.similarity(own, other) >= nearcopies.ALIKE]
        assert leaders.like(own) == want
        if not want:
            leaders.add(i, own)
            plain.append((i, own))
    assert len(plain) > 5


@pytest.mark.parametrize("n, most", [(0, 1 << 29), (3000, 1 << 29), (60_000, 1 << 16)])
def test_a_filter_misses_nothing(spark, n, most):
    rng = np.random.default_rng(n)
    known = rng.integers(-(2**63), 2**63 - 1, n)
    df = spark.createDataFrame([(int(x),) for x in known], "gram long").repartition(4)
    held = decontaminate.hash_filter(df, most)
    assert len(held) * 8 <= most and decontaminate.may_hold(held, known.view(np.uint64)).all()
    other = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    share = decontaminate.may_hold(held, other).mean()
    assert share < 0.01 if most > 1 << 16 else share > 0.5


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = Counter(map(tuple, decontaminate.decontaminate(docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "hash_filter", lambda hashes: np.full(1 << 13, 255, np.uint8))
    assert Counter(map(tuple, decontaminate.decontaminate(docs, benchmark).collect())) == want


def test_rows_that_other_columns_tell_apart_stay(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(5, text, "en", "s"), (5, text, "de", "s"), (5, text, "de", "s"), (6, text + " eleven", "en", "s"), (None, text, "fr", "s"), (7, "", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    assert Counter(map(tuple, mixing.mixed(docs, block=1).collect())) == Counter(rows[:-1])  # one source takes its own size
    kept = [sorted(map(tuple, simhash.one_of_each(docs.repartition(k)).collect()), key=repr) for k in (1, 4)]
    assert kept[0] == kept[1] and len([r for r in kept[0] if r[1] == text]) == 1


def test_no_tie_between_classes_is_lost(spark):
    """Texts that are each like another leader are still tied; so are texts that share only one key, which is hot."""
    rng = np.random.default_rng(8)
    bits = rng.choice(1 << 31, 1000, replace=False).astype(np.uint32)
    take = lambda lo, hi, base: np.sort(bits[base + lo : base + hi])
    rows, chains = [], 6
    for c in range(chains):
        # Windows over 100 values: each is like those within 10 places. The leaders 0 and 30 aren't, nor are 10 and 20 like the other one's leader.
        for k, at in enumerate((0, 30, 10, 20)):
            rows.append((10 * c + k, 10 * c + k, [7, 1000 + 10 * c + k], take(at, at + 100, 140 * c)))
    prints = spark.createDataFrame([(t, f, k, bytearray(s.tobytes())) for t, f, k, s in rows], "th long, fp long, keys array<long>, sketch binary")
    near = {(a, b) for a, _, _, x in rows for b, _, _, y in rows if a < b and nearcopies.similarity(x, y) >= nearcopies.ALIKE}
    assert len(near) == 3 * chains
    for limit in (4, 8, 4096):
        got = {tuple(sorted((r["a"], r["b"]))) for r in nearcopies.near_links(prints, limit).collect()}
        assert got == near
