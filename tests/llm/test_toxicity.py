"""Operator 12: the automaton against plain edit distances, held-out accuracy, misspellings, quotations, awkward rows."""

import random
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoline.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, toxic string, score string, th string, weight string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row


def brute_match(word, terms):
    best = None
    for i, (term, stem) in enumerate(terms):
        ends = distance(term, word)
        e = min(ends) if stem else ends[-1]
        if e <= (len(term) >= toxicity.ONE) + (len(term) >= toxicity.TWO):
            best = min(best or (9, 0), (e, i))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_automaton_equals_edit_distances(seed, monkeypatch):
    rng = random.Random(seed)
    word = lambda a, b: "".join(rng.choice("abcé") for _ in range(rng.randint(a, b)))
    terms = list(dict.fromkeys((word(3, 12), rng.random() < 0.4) for _ in range(25)))
    monkeypatch.setattr(toxicity, "STATES", (50, 100_000)[seed % 2])
    automaton = toxicity.Automaton(terms)
    words = [word(0, 14) for _ in range(400)] + [t + word(0, 3) for t, _ in terms]
    for t, _ in terms:
        k = rng.randrange(len(t))
        words += [t[:k] + t[k + 1 :], t[:k] + "b" + t[k:], t[:k] + "z" + t[k + 1 :]]
    for w in words:
        assert automaton.match(w) == brute_match(w, terms), (w, terms)


def test_quotations_end_with_a_mark_or_the_line():
    text = 'a "b c" d «e» “f” „g” "h\ni'
    places, inside = toxicity.quotes(text)
    state = {c: any(p < text.index(c) for p in places) and inside[max(k for k, p in enumerate(places) if p < text.index(c))] for c in "abcdefghi"}
    assert state == {"a": False, "b": True, "c": True, "d": False, "e": True, "f": True, "g": True, "h": True, "i": False}


def auc(y, s):
    y, s = np.asarray(y, bool), np.asarray(s)
    rank = np.array([(s < x).sum() + ((s == x).sum() + 1) / 2 for x in s])
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def held(out, labels):
    rows = out.join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").filter("held_out").collect()
    assert all((r["score"] >= 0.5) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in rows)
    return [r["label"] for r in rows], [r["score"] for r in rows], [r["predicted"] for r in rows]


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.9), ("sf0.1", 0.95)])
def test_held_out_accuracy(spark, sf, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    y, s, p = held(toxicity.toxicity(docs, labels), labels)
    assert auc(y, s) >= least
    clean = [a for a, b in zip(p, y, strict=True) if not b]
    assert sum(clean) / len(clean) < 0.02


def corpus(rng, n):
    """Clean prose, abuse, and clean texts that quote abuse: (doc_id, text), (doc_id, toxic)."""
    bad = ["zorblax", "quimfrot", "vandrik", "plughast"]
    prose = lambda k: [rng.choice(string.ascii_lowercase) + rng.choice(["ane", "oro", "ist", "ula", "ette"]) + rng.choice(["n", "", "s"]) for _ in range(k)]
    docs, labels = [], []
    for i in range(n):
        words, kind = prose(rng.randint(20, 60)), i % 4
        for _ in range(3):
            at = rng.randrange(len(words) + 1)
            if kind == 1:
                words[at:at] = ["you", rng.choice(bad)]
            if kind == 2:
                words[at:at] = ["you", "wrote", f'"{rng.choice(bad)}"', "yesterday"]
            if kind in (0, 3):
                words[at:at] = ["you"]
        docs.append((i, " ".join(words)))
        labels.append((i, None, int(kind == 1)))
    return docs, labels


def test_quotation_is_told_from_abuse_and_misspellings_are_met(spark):
    rng = random.Random(4)
    docs, labels = corpus(rng, 1200)
    docs += [(5000, "nane pula you zorblx sista"), (5001, "nane pula you quimfrotx you vandrk sista"), (5002, "nane pula sista lula"), (5003, 'nane he wrote "zorblax" yesterday pula')]
    df, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, marks)
    assert {t for t, _ in model.terms} >= {"zorblax", "quimfrot"} or any(stem for _, stem in model.terms)
    out = toxicity.score(df, model).withColumn("held_out", toxicity._held_out()).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    y, s, p = held(out, marks)
    assert auc(y, s) > 0.99 and np.mean(np.array(y) == np.array(p)) > 0.97
    by_id = {r["doc_id"]: r for r in out.filter("doc_id >= 5000").collect()}
    assert by_id[5000]["n_misspelled"] == 1 and by_id[5001]["n_misspelled"] == 2
    assert by_id[5001]["score"] > 0.5 > by_id[5003]["score"] and by_id[5000]["score"] > by_id[5002]["score"]


def test_copies_of_one_text_make_no_terms(spark):
    rng = random.Random(6)
    docs, labels = corpus(rng, 400)
    odd = "marvellous umbrella collection for rainy afternoons"
    docs += [(10_000 + i, f"{odd} you zorblax") for i in range(300)] + [(20_000 + i, f"{odd} {i} you vandrik") for i in range(40)]
    labels += [(d, None, 1) for d, _ in docs[400:]]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert not any("umbrella".startswith(t) or "collection".startswith(t) for t, _ in model.terms)


def test_awkward_rows(spark):
    rng = random.Random(8)
    docs, labels = corpus(rng, 300)
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "zorblax " * 50_000), (None, "you zorblax"), (1004, "you zorblax"), (1004, "you zorblax"), (1005, "1 2 ..."), (1006, "Ünï çôdé 𝒳")]
    labels += [(None, 1, 1), (1001, 0, 1), (1000, 0, None), (3, 0, None), (5, 0, 1), (5, 0, 0)]
    df = spark.createDataFrame([(i, t) + (None,) * 7 for i, t in docs], DOCS).repartition(4)
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, text string")
    out = toxicity.toxicity(df, marks).collect()
    assert len(out) == len(docs)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert len({by[k][0]["score"] for k in (1000, 1001, 1002)}) == 1 and len({r["score"] for r in by[1004] + by[None]}) == 1
    assert by[1004][0]["score"] > by[1000][0]["score"] and by[1003][0]["n_terms"] == 50_000
    again = toxicity.toxicity(df.repartition(7), marks).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    assert toxicity.toxicity(df.limit(0), marks).collect() == []
    assert all(r["score"] == pytest.approx(toxicity.PRIOR) for r in toxicity.toxicity(df, marks.limit(0)).collect())
