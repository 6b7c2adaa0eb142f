"""Every corpus operator against a brute-force version, over awkward rows: nulls, empty and very long texts,
repeated rows, ties, clashing column names, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from echoline.llm import chunking, common, decontaminate, langid, mixing, nearcopies, pseudolikelihood, repeats, secrets, sharding, simhash, warc
from tests.oracle import expected, rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in ("rid", "th", "key", "score", "fp", "n", "taken", "part", "bytes"))


@pytest.fixture(scope="module")
def table():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeghinorst") for _ in range(rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, texts = prose(120), []
    for i in range(40):
        texts.append(prose(rng.randint(1, 200)))
    texts += [passage + " " + prose(40), prose(33) + "\n" + passage, passage[3:] + " é" + prose(9), texts[0], texts[1], texts[1] + "x"]
    texts += [None, "", " ", "\n\t", ".", "A.", "1 2 3", "one", "One Two", "日本語 テキスト", "𝒳𝒴 letters", "ab " * 3000, "z" * 5000, prose(20000)]
    texts += ["Token=tok token:abcdefg 'SECRET' = \"abc/def=\"", "AKIA" + "B" * 15 + " AKIA" + "7" * 16, "f" * 23 + " é " + "0a" * 12, 'api_key: "9233A8ECF7C5B09FE594" ' + "Q7x" * 3]
    out = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None, "s0", "s1")[i % 5], None) for i, t in enumerate(texts)]
    out += [out[0], out[44], (5, prose(30), None, None, 3), (None, None, None, None, None), (None, passage, "en", "s1", 1), (None, passage, "en", "s1", 1)]
    return [r + (None,) * 9 for r in out]


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def same(df, want):
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(want, key=repr)


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")


# --- 1 ----------------------------------------------------------------------------------------------------------
def base_spans(x):
    found = []
    for order, (kind, pattern, group, least) in enumerate((
        ("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))):
        for m in re.finditer(pattern, x or "", re.I | re.A if kind == "assign" else 0):
            if len(m[group]) >= least:
                found.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_secrets(spark, docs, nothing, table):
    got = secrets.secrets(docs)
    want = [(r[0], *[sum(k == kind for k, _, _ in base_spans(r[1])) for kind in secrets.BASE], sha(",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(r[1])))) for r in table]
    same(got.drop("spans"), want)
    assert secrets.secrets(nothing).count() == 0
    model = secrets.train(secrets.random_samples(spark).unionByName(secrets.ordinary_samples(docs)))
    probe = [("key 9233A8ECF7C5B09FE5949719B6B82BC439E9329B", True), ("use wJalrXUtnFEMIK7MDENGbPxRfiCY8sdfKEY", True), ("a_long_ordinary_name_of_words", False), ("4550997810720808123456", False), ("-" * 40, False), ("=" * 40, False)]
    found = secrets.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(probe)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [any(s["kind"] == "random" for s in r["found"]) for r in found] == [x for _, x in probe]


def test_markov_models_hold_out(spark):
    """Accuracy on random strings and on identifiers of documents that the fit has not seen."""
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = secrets.train(secrets.random_samples(spark, 500).unionByName(secrets.ordinary_samples(real.filter("doc_id % 2 = 0"))))
    fresh = spark.createDataFrame([(hashlib.sha512(str(i).encode()).hexdigest()[:40].upper(), 1) for i in range(200)], "text string, label int")
    other = secrets.ordinary_samples(real.filter("doc_id % 2 = 1")).filter(F.length("text") >= 20).select("text", "label")
    for part in (fresh, other):
        got = part.select((F.col("label") == (secrets.ratio(F.col("text"), model) > 0).cast("int")).cast("int").alias("ok"))
        assert got.agg(F.avg("ok")).first()[0] > 0.95


def test_random_spans_in_documents(spark):
    """Precision and recall of the models' spans: random strings in prose that the fit has not seen, beside long names."""
    rng = random.Random(11)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    prose = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id % 2 = 1 and length(text) > 200").select("text").limit(80).collect()]
    made, where = [], {}
    for i, t in enumerate(prose):
        t = re.sub(r"[A-Za-z0-9+/_.=-]{20,}", "x", t)
        names = " a_long_name_of_parts_for_reading some.package.with.many.parts the-title-of-a-long-page "
        if i % 2:
            key = "".join(rng.choice(signs) for _ in range(rng.randint(28, 48)))
            where[i] = (100 + len(names), 100 + len(names) + len(key))
            t = t[:100] + names + key + " " + t[100:]
        else:
            t = t[:100] + names + t[100:]
        made.append((i, t))
    learned = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id % 2 = 0")
    model = secrets.train(secrets.random_samples(spark).unionByName(secrets.ordinary_samples(learned)))
    found = [(r["doc_id"], x["start"], x["end"]) for r in secrets.scan(spark.createDataFrame(made, "doc_id long, text string"), model).collect() for x in r["found"] if x["kind"] == "random"]
    right = {i for i, a, b in found if i in where and a < where[i][1] and b > where[i][0]}
    assert len(right) / len(where) > 0.9
    assert sum(i in where and a < where[i][1] and b > where[i][0] for i, a, b in found) / len(found) > 0.9


# --- 2 ----------------------------------------------------------------------------------------------------------
def kept(texts, span):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[p : p + span] for x in raw for p in range(len(x) - span + 1))
    for x in raw:
        gone = np.zeros(len(x) + 1, np.int8)
        for p in range(len(x) - span + 1):
            if seen[x[p : p + span]] > 1:
                gone[p : p + span] = 1
        yield len(x), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), sha(np.frombuffer(x, np.uint8)[gone[:-1] == 0].tobytes())


@pytest.mark.parametrize("limit", [1500, 1])
def test_repeats(docs, nothing, table, limit):
    want = [(r[0], *k) for r, k in zip(table, kept([r[1] for r in table], 400))]
    got = repeats.remove_repeats(docs, limit=limit)
    same(got.drop("n_shared_words"), want)
    assert repeats.remove_repeats(nothing).count() == 0


def test_shared_words(spark):
    """A passage of 50 words that repeats always shows, with at most the words of repeated 26-grams; no other does."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 5)))
    parts = [[word() for _ in range(n)] for n in (50, 50, 70, 30, 25, 20)]
    texts = ["", None, "one two", " ".join(parts[2])]
    for i in range(40):
        text = [word() for _ in range(rng.randint(0, 90))]
        for p in rng.sample(parts, rng.randint(0, 2)):
            text += [*p, *(word() for _ in range(rng.randint(0, 60)))]
        texts.append(", ".join(text))
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) for t in texts]
    seen = {n: Counter(tuple(w[p : p + n]) for w in split for p in range(len(w) - n + 1)) for n in (26, 50)}
    got = {r["doc_id"]: r["n_shared_words"] for r in repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, w in enumerate(split):
        covered = {q for p in range(len(w) - 25) if seen[26][tuple(w[p : p + 26])] > 1 for q in range(p, p + 26)}
        assert got[i] <= len(covered)
        if any(seen[50][tuple(w[p : p + 50])] > 1 for p in range(len(w) - 49)):
            assert got[i] >= 26
    assert sum(x > 0 for x in got.values()) > 10 and sum(x == 0 for x in got.values()) > 10


def test_index_follows_runs():
    """The runs spell the transform of a plain suffix order, and fewer samples than places tell the matches."""
    rng = random.Random(8)
    base = bytes(rng.choice(b"abc") for _ in range(500))
    segments = [base, base[:450] + b"z" + base[451:], base[20:]]
    index = repeats.RunIndex.of(segments)
    signs = [c for i, s in enumerate(segments) for c in (*s, 256 + i)]
    order = sorted(range(len(signs)), key=lambda p: signs[p:])
    plain = [min(signs[p - 1], 255) for p in order]
    assert [int(c) for c, a, b in zip(index.letters, index.start, index.stop) for _ in range(a, b + 1)] == plain
    assert len(index.start) < len(signs) // 2
    best = index.longest(np.arange(3), 400)
    for s, a in zip(segments, index.starts):
        for p in range(0, len(s), 7):
            most = max(n for n in range(len(s) - p + 1) if sum(t[q : q + n] == s[p : p + n] for t in segments for q in range(len(t) - n + 1)) > 1)
            assert min(most, 400) == min(best[a + p], 400)


def test_marked_equals_brute_force():
    rng = random.Random(1)
    for n, signs in ((3, b"ab"), (40, b"abcdef"), (40, b"a")):
        base = bytes(rng.choice(signs) for _ in range(700))
        segments = []
        for _ in range(n):
            x = bytearray(base[: rng.randint(400, 700)])
            for _ in range(rng.randint(0, 2)):
                x[rng.randrange(len(x))] = 122
            segments.append(bytes(x))
        seen = Counter(s[p : p + 400] for s in segments for p in range(len(s) - 399))
        want = [np.zeros(len(s), bool) for s in segments]
        got = [np.zeros(len(s), bool) for s in segments]
        for w, s in zip(want, segments):
            for p in range(len(s) - 399):
                if seen[s[p : p + 400]] > 1:
                    w[p : p + 400] = True
        for i, a, b in repeats.marked(segments, 400):
            got[i][a:b] = True
        assert all((g == w).all() for g, w in zip(got, want))


def test_equal_windows_have_equal_anchors():
    data = np.frombuffer(random.Random(2).randbytes(3000) * 2, np.uint8)
    start, end, at, key = repeats.anchored(data)
    owner = np.repeat(np.arange(len(start)), end - start - 399)
    assert len(owner) == len(data) - 399
    half = len(data) // 2
    assert all(key[owner[p]] == key[owner[p + half]] and at[owner[p]] - p == at[owner[p + half]] - p - half for p in range(half - 399))


# --- 3 ----------------------------------------------------------------------------------------------------------
def test_languages(spark, docs, nothing, table):
    got = langid.languages(docs).collect()
    assert len(got) == len(table) and langid.languages(nothing).count() == 0
    letters = {id_: any(c.isalpha() for c in t or "") for id_, t, *_ in table if id_ not in (None, 0, 5, 44)}
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if r["doc_id"] in letters:
            assert (r["lang_pred"] == "und") == (not letters[r["doc_id"]])
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hit = langid.languages(real).join(real, "doc_id").filter("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok"))
    assert hit.agg(F.avg("ok")).first()[0] > 0.97


def brute_profile(texts):
    """N-grams of words with their borders, most frequent first, equal ones by length and code points."""
    n = Counter()
    for t in texts:
        points = [max(ord(c) & 0xFFFF, 1) if c.isalpha() else 0 for c in t.lower()]
        word = []
        for p in [*points, 0]:
            if p:
                word.append(p)
            elif word:
                row = [0, *word, 0]
                n.update((1, p) for p in word)
                n.update((2, *row[i : i + 2]) for i in range(len(row) - 1))
                n.update((3, *row[i : i + 3]) for i in range(len(row) - 2))
                word = []
    return sorted(n, key=lambda g: (-n[g], g))[: langid.KEPT]


def brute_languages(table):
    learn = {}
    for i, t, lang, *_ in table:
        if i is not None and t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            learn.setdefault(lang, []).append(t)
    profiles = {k: {g: i for i, g in enumerate(brute_profile(v))} for k, v in learn.items()}
    for _, t, *_ in table:
        own = brute_profile([t or ""])
        away = sorted((sum(abs(p[g] - i) if g in p else langid.KEPT for i, g in enumerate(own)), lang) for lang, p in profiles.items())
        yield (away[0][1], 1 - away[0][0] / (langid.KEPT * len(own))) if own else ("und", 0.0)


def test_languages_equal_brute_force(docs, table):
    got = Counter((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in langid.languages(docs).collect())
    assert got == Counter((r[0], lang, round(score, 9)) for r, (lang, score) in zip(table, brute_languages(table)))


# --- 4 ----------------------------------------------------------------------------------------------------------
def test_decontamination(spark, docs, nothing, table):
    texts = [r[1] for r in table]
    items = [(0, texts[41][:400]), (1, texts[2][:200]), (2, "One two"), (3, None), (4, "..."), (5, "One two"), (6, texts[3]), (None, texts[3]), (8, "日本語"), (9, "ab " * 15)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench)
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    windows = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[p : p + 10]), set()).add(i)
    want = []
    for r in table:
        w, hit, found = words(r[1]), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[p : p + n]))) is not None:
                    hit |= set(range(p, p + n))
                    found |= own
        named = sorted(str(i) for i in found if i is not None)
        want.append((r[0], len(w), len(hit), len(named), sha(",".join(named)), bool(hit)))
    same(got, want)
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0
    whole = decontaminate.clean(docs, bench)
    assert whole.columns == docs.columns and whole.count() == sum(not w[-1] for w in want)


def test_every_shared_span_is_found():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 2**63, 60).astype(np.uint64), rng.integers(0, 2**63, 60).astype(np.uint64)
        i, j = rng.integers(0, 50, 2)
        b[j : j + 10] = a[i : i + 10]
        kept = [set(decontaminate.gram_hashes(x, 5)[decontaminate.winnow(x, np.zeros(60, int), 10, 5)].tolist()) for x in (a, b)]
        assert kept[0] & kept[1]


# --- 5 ----------------------------------------------------------------------------------------------------------
def network(seed=2):
    rng = np.random.default_rng(seed)
    size = pseudolikelihood.Size(2048, 64)
    weights = {k: rng.normal(0, 0.3, v).astype(np.float32) for k, v in size.shapes().items()}
    hashes = np.sort(rng.integers(0, 2**63, 960).astype(np.uint64))
    return pseudolikelihood.Model(size, hashes, rng.permutation(960), weights)


def brute_log_probability(near, target, w):
    x = sum(w["near"][k][u].astype(float) for k, u in enumerate(near)) + w["bias"]
    h = x / (1 + np.abs(x))
    kind, word = divmod(int(target), w["word"].shape[1])
    log_softmax = lambda x: x - np.log(np.exp(x).sum())
    return log_softmax(w["kind"] @ h + w["kind_bias"])[kind] + log_softmax(w["word"][kind] @ h + w["word_bias"][kind])[word]


def test_log_probabilities_are_a_distribution():
    w, units = network().weights, network().size.units
    near = np.tile(np.array([[3], [units], [7], [1000]]), (1, units))
    got = pseudolikelihood.log_probabilities(near, np.arange(units), w)
    assert np.exp(got.astype(float)).sum() == pytest.approx(1, abs=1e-4)
    assert got[::37] == pytest.approx([brute_log_probability(near[:, 0], t, w) for t in range(0, units, 37)], abs=1e-4)


def test_a_step_goes_down_the_gradient():
    rng, w = np.random.default_rng(4), network().weights
    near, target = rng.integers(0, 2049, (4, 40)), rng.integers(0, 2048, 40)
    loss = lambda: -pseudolikelihood.log_probabilities(near, target, w).astype(float).mean()
    before = {k: v.copy() for k, v in w.items()}
    # With a large history the step is the gradient times a constant.
    pseudolikelihood.step(near, target, w, {k: np.full(v.shape, 1e6, np.float32) for k, v in w.items()}, rate=1e3)
    moved = {k: before[k] - v for k, v in w.items()}
    for name, at in (("bias", (3,)), ("kind", (5, 2)), ("near", (2, near[2, 0], 9)), ("word", (target[0] // 32, target[0] % 32, 4)), ("word_bias", (target[1] // 32, 0))):
        for k in w:
            w[k][:] = before[k]
        w[name][at] += 0.01
        up = loss()
        w[name][at] -= 0.02
        assert moved[name][at] == pytest.approx((up - loss()) / 0.02, abs=2e-4)


def test_scores_equal_brute_force(docs, nothing, table):
    model = network()
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    got = pseudolikelihood.score(docs, model).collect()
    assert Counter((r["doc_id"], r["n_words"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in table)
    assert pseudolikelihood.score(nothing, model).count() == 0
    sums = {(r["doc_id"], r["n_words"]): r for r in got}
    for i in (3, 41, 46, 47, 52, 53):
        raw = (table[i][1] or "").encode()
        h, _ = decontaminate.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        tails = pseudolikelihood.endings(*decontaminate.word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
        border = [model.size.border] * 2
        u = border + pseudolikelihood.units_of(h, tails, model).tolist() + border
        want = sum(brute_log_probability([u[p - 2], u[p - 1], u[p + 1], u[p + 2]], u[p], model.weights) for p in range(2, len(u) - 2))
        r = sums[(table[i][0], len(h))]
        assert r["log_likelihood"] == pytest.approx(want, abs=0.01 + 1e-4 * abs(want))
        assert (r["mean_log_likelihood"] is None) == (len(h) == 0)


def test_word_counts(docs, table):
    got = {r["word"]: r["n"] for r in pseudolikelihood.word_counts(docs).collect()}
    want = Counter(w for r in table for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r[1])))
    assert sorted(got.values()) == sorted(want.values())


def test_pseudo_likelihood_on_held_out_documents(spark, nothing):
    """The network predicts unseen documents better than word frequencies do, and tells their order from a shuffled one."""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen, other = real.filter("doc_id % 4 <> 0"), real.filter("doc_id % 4 = 0")
    mean = lambda df, m: pseudolikelihood.score(df, m).agg(F.sum("log_likelihood") / F.sum("n_words")).first()[0]
    model = pseudolikelihood.fit(seen)
    mixed = other.withColumn("text", F.array_join(F.shuffle(F.split("text", " "), 5), " "))
    base, got = mean(other, pseudolikelihood.untrained(pseudolikelihood.word_counts(seen))), mean(other, model)
    assert got > base + 0.15 and got > mean(mixed, model) + 0.05
    assert pseudolikelihood.score_documents(nothing).count() == 0


def test_scores_do_not_depend_on_partitions(spark):
    """The same scores for 4 and 32 partitions, with and without adaptive execution, and however the table is cut."""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id % 3 = 0")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    found = []
    try:
        for partitions, adaptive, cut in ((4, "true", 1), (32, "false", 7), (32, "true", 3)):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            found.append({r["doc_id"]: r["mean_log_likelihood"] for r in pseudolikelihood.score_documents(real.repartition(cut)).collect()})
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    for other in found[1:]:
        assert other.keys() == found[0].keys()
        assert all(other[k] is None if v is None else abs(other[k] - v) < 1e-3 for k, v in found[0].items())


def test_every_place_is_trained_once(docs, table, monkeypatch):
    """Pieces cover all words of all texts, each in one slot, with their neighbours; long texts are cut."""
    monkeypatch.setattr(pseudolikelihood, "PIECE", 700)
    model = pseudolikelihood.untrained(pseudolikelihood.word_counts(docs))
    rows = pseudolikelihood.encoded(docs, model, 6).collect()
    cells = [np.frombuffer(r["cells"], model.size.kind) for r in rows]
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    assert sum(len(c) - 4 for c in cells) == sum(len(words(r[1])) for r in table) and max(map(len, cells)) == 704
    assert {r["slot"] for r in rows} == set(range(6)) and all(0 < len(c) - 4 <= 700 for c in cells)
    long = max(range(len(table)), key=lambda i: len(table[i][1] or ""))
    raw = table[long][1].encode()
    at = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    h, _ = decontaminate.word_hashes(*at)
    want = [model.size.border] * 2 + pseudolikelihood.units_of(h, pseudolikelihood.endings(*decontaminate.word_spans(*at)), model).tolist() + [model.size.border] * 2
    by_key = {}
    for r, c in zip(rows, cells, strict=True):
        by_key.setdefault(r["key"], {})[r["part"]] = c.tolist()
    whole = max(by_key.values(), key=len)
    got = whole[0][:2] + [u for k in sorted(whole) for u in whole[k][2:-2]] + whole[max(whole)][-2:]
    assert got == want and all(whole[k][-4:] == whole[k + 1][:4] for k in range(len(whole) - 1))


def test_the_network_grows_with_the_words():
    sizes = [pseudolikelihood.size_of(n) for n in (0, 1000, 70_000, 1_500_000, 50_000_000, 10**10)]
    assert all(a.units < b.units for a, b in zip(sizes, sizes[1:], strict=False)) and all(s.classes * s.wide == s.units and s.known + s.rest == s.units for s in sizes)
    assert sizes[-1].kind is np.uint32


def test_words_outside_the_vocabulary_are_scored_by_their_counts(spark, docs, nothing, table):
    """Shares equal brute force, whether listed or joined; text of unseen words scores below clean text."""
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    hashed = lambda x: int(decontaminate.word_hashes(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]))[0][0])
    ending = lambda x: int(common.mix64(np.array([int.from_bytes(x.encode()[-3:], "big")], np.uint64))[0])
    counts = pseudolikelihood.word_counts(docs)
    model = pseudolikelihood.untrained(counts)
    n = Counter(hashed(w) for r in table for w in words(r[1]))
    known, rest = set(model.hashes.tolist()), model.size.rest
    assert len(n) > len(known) == model.size.known
    total, once, unit = Counter(), Counter(), {}
    for w in {w for r in table for w in words(r[1])}:
        unit[hashed(w)] = ending(w) % rest
    for h, m in n.items():
        if h not in known:
            total[unit[h]] += m
            once[unit[h]] += m == 1

    def share(w):
        h, size, of = hashed(w), len(w.encode()), ending(w) % rest
        if h in known:
            return 0.0
        unseen, spelled = max(1, once[of]), rest / 8 * (7 / 8) ** (size - 1) / 164.0**size
        return np.log((n[h] + unseen * spelled) / (total[of] + unseen))

    probe = docs.filter("length(text) < 3000").unionByName(spark.createDataFrame([(900, "qqzzk never seen qqzzk"), (901, "é")], "doc_id long, text string"), allowMissingColumns=True)
    network = pseudolikelihood.Model(model.size, model.hashes, model.units, model.weights)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["log_likelihood"])
    plain = sorted(pseudolikelihood.score(probe, network).collect(), key=key)
    text = {}
    for r in probe.collect():
        text.setdefault((r["doc_id"], len(words(r["text"]))), r["text"])
    for listed in (1 << 18, 5, 0):
        own = pseudolikelihood.untrained(counts, listed=listed)
        assert (own.shares.counts is None) == (listed > 5)
        got = sorted(pseudolikelihood.score(probe, own).collect(), key=key)
        base = {(r["doc_id"], r["n_words"]): r["log_likelihood"] for r in plain}
        assert len(got) == len(plain)
        for r in got:
            at = (r["doc_id"], r["n_words"])
            assert r["log_likelihood"] == pytest.approx(base[at] + sum(share(w) for w in words(text[at])), abs=0.01)
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(8)
    junk = [(i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 9))) for _ in range(80))) for i in range(20)]
    fitted = pseudolikelihood.fit(real.filter("doc_id % 4 <> 0"))
    clean = pseudolikelihood.score(real.filter("doc_id % 4 = 0"), fitted).agg(F.sum("log_likelihood") / F.sum("n_words")).first()[0]
    most = pseudolikelihood.score(spark.createDataFrame(junk, "doc_id long, text string"), fitted).agg(F.max("mean_log_likelihood")).first()[0]
    assert most < clean - 5


# --- 6 ----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("parts", [1, 3, 50])
def test_fingerprints(docs, nothing, table, parts):
    order = sorted(table, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = []
    for r, nxt in zip(order, order[1:] + order[:1]):
        t, x = r[1] or "", nxt[1] or ""
        want.append((r[0], len(t), sha(t[: len(t) - len(t) // 4] + x[: len(t) // 4])))
    got = chunking.fingerprints(docs, parts)
    same(got.select("doc_id", "n_chars", "edited_sha256"), want)
    assert got.filter("near_edited < 0 or near_edited > 1 or near_next < 0 or near_next > 1").count() == 0
    assert chunking.fingerprints(nothing, parts).count() == 0


def brute_chunks(data):
    """Byte by byte: digest to length."""
    out, h, start = {}, 0, 0
    for i, c in enumerate(data):
        h = ((h << 1) + int(chunking.GEAR[c])) & 0xFFFFFFFF
        size = i + 1 - start
        limit = 0 if size < chunking.LEAST else int(chunking.STRICT) if size <= chunking.NORMAL else int(chunking.LOOSE)
        if h < limit or size == chunking.MOST or i + 1 == len(data):
            out[xxhash.xxh3_64_intdigest(data[start : i + 1]) & 0xFFFFFFFFFFFF] = size
            start = i + 1
    return out


def test_fingerprints_equal_brute_force(docs, table):
    import base64

    def packed(chunks):
        return base64.b64encode(b"".join(d.to_bytes(6, "big") + chunks[d].to_bytes(2, "big") for d in sorted(chunks))).decode()

    def inside(a, b):
        return sum(n for d, n in a.items() if d in b) / sum(a.values()) if a else float(not b)

    order = sorted(table, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = []
    for r, nxt in zip(order, order[1:] + order[:1]):
        t, x = r[1] or "", nxt[1] or ""
        own, edited, other = (brute_chunks(v.encode()) for v in (t, t[: len(t) - len(t) // 4] + x[: len(t) // 4], x))
        want.append((r[0], packed(own), packed(edited), inside(own, edited), inside(own, other)))
    same(chunking.fingerprints(docs, 3).select("doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next"), want)


def test_chunks_resist_shifts_and_resume():
    rng = random.Random(4)
    a = bytes(rng.choice(b"abcdefgh ") for _ in range(20000))
    sets = [chunking.chunk_set(x, chunking.cuts(x)) for x in (a, b"shift" + a)]
    assert chunking.containment(*sets) > 0.95 and chunking.containment({}, {}) == 1.0 and chunking.containment({1: 3}, {}) == 0.0
    ends = chunking.cuts(a)
    assert max(np.diff([0, *ends])) <= chunking.MOST and ends[-1] == len(a)
    assert chunking.cuts(a, ends[:100]) == ends and chunking.cuts(b"") == []


# --- 7 ----------------------------------------------------------------------------------------------------------
def brute_simhash(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(x))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(prints, reach=2):
    left, out = set(prints), {}
    while left:
        front, own = [left.pop()], []
        while front:
            u = front.pop()
            own.append(u)
            near = {v for v in left if (u ^ v).bit_count() <= reach}
            left -= near
            front += near
        out |= dict.fromkeys(own, min(own))
    return out


@pytest.mark.parametrize("limit", [8192, 1])
def test_simhash(docs, nothing, table, limit):
    prints = [brute_simhash(r[1]) for r in table]
    roots = brute_components(prints)
    least = {}
    for r, p in zip(table, prints):
        if r[0] is not None:
            least[roots[p]] = min(r[0], least.get(roots[p], r[0]))
    same(simhash.near_duplicates(docs, limit), [(r[0], f"{p:016x}", least.get(roots[p])) for r, p in zip(table, prints)])
    assert simhash.near_duplicates(nothing).count() == 0
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == len(set(roots.values()))


@pytest.mark.parametrize("limit", [8192, 3])
def test_links_lose_nothing(spark, limit):
    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in rng.sample(sorted(prints), 40):
        for _ in range(30):
            prints.add(p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    edges = simhash.link(df, limit)
    assert all((a ^ b) & simhash.FULL and ((a ^ b) & simhash.FULL).bit_count() <= 2 for a, b in edges.collect())
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = brute_components(prints)
    assert classes({signed(k): v for k, v in want.items()}) == classes(got)


def classes(roots):
    out = {}
    for node, root in roots.items():
        out.setdefault(root, set()).add(node)
    return {frozenset(x) for x in out.values() if len(x) > 1}


def test_ring_budgets():
    assert simhash.budgets() == [(3, 0), (7, 1), (8, 2)]


# --- 8 ----------------------------------------------------------------------------------------------------------
def test_mixing(docs, nothing, table, monkeypatch):
    import pandas as pd

    got = mixing.mix(docs)
    frame = pd.DataFrame([r[:4] for r in table], columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})
    assert rows(got.toPandas()) == rows(expected(mixing.MIX_SQL, documents=frame))
    data = got.toPandas()
    total = data["size"].sum()
    per = data.groupby(data.source.fillna("~")).agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"))
    assert per.target.sum() == pytest.approx(total) and (per.taken - per.target).abs().max() <= 3 * 64 and (per.target <= 3 * per["size"] + 1e-9).all()
    assert (data.taken <= 3 * data["size"]).all() and (data.first_slot.notna() == (data.taken > 0)).all()
    assert rows(mixing.mix(docs).toPandas()) == rows(data)
    assert mixing.mix(nothing).count() == 0
    # The sequence decides: with all points equal, one source has all slots; another multiplier deals them in another order.
    monkeypatch.setattr(mixing, "GOLDEN", 0)
    one = mixing.mix(docs).toPandas()
    assert one[one.taken > 0].source.fillna("~").nunique() == 1
    monkeypatch.setattr(mixing, "GOLDEN", 1)
    assert rows(mixing.mix(docs).select("doc_id", "first_slot").toPandas()) != rows(data[["doc_id", "first_slot"]])


def test_mixed_rows_come_in_slot_order(spark, docs, nothing):
    """Each row as often as the mix takes it, in the order of its slots; nothing but the last document of a source is rounded."""
    streams, rounds = mixing.takes(docs)
    full = rounds.join(streams.filter("size > 0"), ["sid", "at"]).filter("2 * taken >= size").orderBy("slot").collect()
    got = mixing.mixed(docs)
    assert got.columns == docs.columns and mixing.mixed(nothing).count() == 0
    have = got.select("doc_id", F.xxhash64("text").alias("th")).collect()
    assert Counter((r["doc_id"], r["th"]) for r in have) == Counter((r["doc_id"], r["th"]) for r in full)
    slot = {}
    for r in full:
        slot.setdefault((r["doc_id"], r["th"]), []).append(r["slot"])
    firsts = [min(slot[k]) for k in dict.fromkeys((r["doc_id"], r["th"]) for r in have)]
    assert firsts == sorted(firsts)
    part = rounds.join(streams, ["sid", "at"]).filter("size > 0 and taken < size").groupBy("sid").count().agg(F.max("count")).first()[0]
    assert part is None or part == 1


def test_targets_refill(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 90), (None, 900)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and sum(got.values()) == pytest.approx(2000)
    want, left, weights, full = {}, 2000.0, {"a": 5, "b": 2, "c": 1, None: 5}, {}
    caps = {"a": 30, "b": 3000, "c": 270, None: 2700}
    while True:
        free = {s: w for s, w in weights.items() if s not in full}
        want = {s: (left - sum(full.values())) * w / sum(free.values()) for s, w in free.items()}
        over = {s: caps[s] for s, t in want.items() if t > caps[s]}
        if not over:
            break
        full |= over
    assert got == pytest.approx(want | full)


def test_schedule_is_spread_evenly(spark):
    """Slots of a source have each rank once, in the order of time, and at any time about its share of all slots."""
    sizes = spark.createDataFrame([(f"s{i}", 50 + 371 * i) for i in range(9)], "source string, source_size long")
    sources = mixing.targets(sizes)
    got = mixing.schedule(sources, 4, chunk=50).toPandas()
    total = -(-int(sum(50 + 371 * i for i in range(9))) // 4)
    assert sorted(got.t) == list(range(total))
    for r in sources.collect():
        own = got[got.sid == r["sid"]].sort_values("t")
        assert list(own["rank"]) == list(range(len(own)))
        share = (r["hi"] - r["lo"]) / mixing.PERIOD
        assert all(abs((own.t < n).sum() - share * n) <= 4 for n in range(0, total, 97))


# --- 9 ----------------------------------------------------------------------------------------------------------
def test_warc(spark, tmp_path):
    import pandas as pd

    long = "<p>é" * 40
    pages = [(3, "http://a/", long), (1, "http://b/ ü\r\nX: y", long), (2, None, None), (4, "u", "short"), (5, "v", "short"), (6, "w", "WARC/1.0\r\n\r\n" + "x" * 200 + "\r\n\r\nWARC/1.0\r\n"), (7, "big", "y" * 300000), (None, "n", long), (None, "m", None), (9, "r", "z" * 120), (9, "r", "z" * 120), (10, "s", "z" * 120)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = warc.page_records(df)
    frame = pd.DataFrame(pages, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})
    assert rows(got.toPandas()) == rows(expected(warc.WARC_SQL, pages=frame))
    assert warc.page_records(df.limit(0)).count() == 0
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path)
    back = warc.captures(spark, path, payloads=True).select("page_id", "url", F.col("payload").cast("string").alias("html"), "capture.request.record_id", "capture.metadata.meta")
    assert sorted(((r[0], r[1], r[2]) for r in back.collect()), key=repr) == sorted(((a, b, c or "") for a, b, c in pages), key=repr)
    assert back.filter("record_id is null or meta is null").count() == 0


def record(kind, block, *lines, end="\r\n"):
    return (end.join(["WARC/1.1", f"WARC-Type: {kind}", *lines, f"Content-Length: {len(block)}"]) + end * 2).encode() + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path, monkeypatch):
    """One gzip member per record, one for all, padding, none at all; odd headers, no pages of ours, pieces of any size."""
    import gzip

    big = b"<p>\r\n\r\n" + random.Random(4).randbytes(3_000_000)
    records = [
        record("warcinfo", b"software: x\r\n", "WARC-Record-ID: <urn:i>"),
        record("response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + big, "warc-record-id:<urn:1>", "WARC-Target-URI:http://a/", "X-Long: one", "\ttwo: three"),
        record("response", b"HTTP/1.0 200 OK\n\nbody", "WARC-RECORD-ID:   <urn:2>"),
        record("request", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <urn:1>", "WARC-Record-ID: <urn:3>", end="\n"),
        record("resource", b"", "WARC-Record-ID: <urn:4>"),
    ]
    (tmp_path / "each.warc.gz").write_bytes(b"".join(map(gzip.compress, records)) + bytes(7))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "nothing.warc").write_bytes(b"")
    got = warc.read_records(spark, f"file://{tmp_path}", payloads=True).collect()
    want = [("warcinfo", "<urn:i>", None, None, None), ("response", "<urn:1>", None, "http://a/", big), ("response", "<urn:2>", None, None, b"body"), ("request", "<urn:3>", "<urn:1>", None, None), ("resource", "<urn:4>", None, None, None)]
    assert Counter((r["type"], r["record_id"], r["concurrent_to"], r["target_uri"], None if r["payload"] is None else bytes(r["payload"])) for r in got) == Counter(want * 3)
    assert {r["payload_digest"] for r in got if r["record_id"] == "<urn:1>"} == {hashlib.sha256(big).hexdigest()}
    for size in (1, 7, 100):
        monkeypatch.setattr(warc, "PIECE", size)
        data = b"".join(map(gzip.compress, records[2:]))
        assert [h["warc-type"] for h, _ in warc.parse(warc.inflated(data[i : i + size] for i in range(0, len(data), size)))] == ["response", "request", "resource"]
    for broken in (data[:-12], b"WARC/1.0\r\nContent-Length: 5\r\n\r\nabc", b"no record\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(warc.inflated([broken])))


# --- 10 ---------------------------------------------------------------------------------------------------------
def brute_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 2000)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump(keys, n).tolist() == [brute_jump(int(k) % (1 << 64), n) for k in keys]
    a, b = sharding.jump(keys, 24), sharding.jump(keys, 25)
    assert set(b[a != b]) == {24} and 0.02 < (a != b).mean() < 0.07


def test_sharding(docs, nothing, table):
    got = sharding.sharded_documents(docs).toPandas()
    assert Counter(map(tuple, got[["size", "text_crc32"]].itertuples(index=False))) == Counter((len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in table)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert ((got.grown_shard == got.shard) | (got.grown_shard == 24)).all()
    assert got.groupby("doc_id")["shard"].nunique().max() == 1
    assert sharding.sharded_documents(nothing).count() == 0


# --- shared -----------------------------------------------------------------------------------------------------
def test_running_sums_over_buckets(spark):
    rng = random.Random(9)
    data = [(rng.choice("ab"), rng.randrange(5), i, rng.randrange(9)) for i in range(200)]
    got = common.running(spark.createDataFrame(data, "p string, b int, o int, v long"), "p", "b", ["o"], "v", "at").collect()
    for r in got:
        assert r["at"] == sum(v for p, b, o, v in data if p == r["p"] and (b, o) < (r["b"], r["o"]))


def jaccard(a, b):
    grams = []
    for x in (a, b):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
        grams.append({tuple(w[p : p + 5]) for p in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return len(grams[0] & grams[1]) / len(grams[0] | grams[1]) if grams[0] and grams[1] else 0.0


@pytest.mark.parametrize("limit", [nearcopies.LIMIT, 5])
def test_near_links_find_near_copies(spark, limit):
    """Pairs with a similarity of 0.8 or more are linked, those far below are not; also where a bucket is dealt anew."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    texts = ["", None, "one two", "one  TWO", "a b c d e"]
    for n in (30, 80, 150, 400, 900):
        base = [word() for _ in range(n)]
        for changed in (0, 1, 2, n // 60, n // 50, n // 8, n // 4):
            w = list(base)
            for p in rng.sample(range(n), changed):
                w[p] = word()
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = simhash.fingerprint(docs, near=True).cache()
    fp = {r["doc_id"]: r["fp"] for r in prints.collect()}
    links = {tuple(sorted((r["a"], r["b"]))) for r in nearcopies.near_links(prints, limit).collect()}
    roots = brute_components_of(links)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    met = [roots.get(fp[i], fp[i]) == roots.get(fp[j], fp[j]) for i, j in near]
    assert len(near) >= 30 and sum(met) / len(met) >= 0.9
    far = {tuple(sorted((fp[i], fp[j]))) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) < 0.65}
    assert not links & far


def brute_components_of(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in list(root)}


def test_stages_on_awkward_rows(spark, docs, nothing, table, tmp_path):
    """Each stage on nulls, empty and long texts, repeated rows, clashing names and no rows at all, against brute force."""
    import corpus_pipeline as c

    spark.createDataFrame([(0, "one two three four"), (1, None), (2, table[41][1][:200])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bench = [("one", "two", "three", "four"), *(tuple(w[p : p + 10]) for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(table[41][1][:200]))] for p in range(len(w) - 9))]
    stages = dict(c.STAGES)
    count = lambda df: Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())
    for name, stage in c.STAGES:
        empty = stage(spark, nothing, str(tmp_path))
        assert empty.count() == 0 and set(docs.columns) <= set(empty.columns), name
    got = stages["language"](spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert count(got) == Counter((r[0], r[1], r[3]) for r, (lang, score) in zip(table, brute_languages(table)) if lang != "und" and score >= 0.1)
    got = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    prints = [brute_simhash(r[1]) for r in table]
    roots = brute_components(prints)
    kept_rows = count(got)
    assert max(kept_rows.values()) == 1
    classes_kept = Counter(roots[brute_simhash(k[1])] for k in kept_rows)
    assert max(classes_kept.values()) == 1
    # A class that is gone has a near copy that stays, directly or over links.
    for x in {roots[p] for p in prints} - set(classes_kept):
        own = [r[1] for r, p in zip(table, prints) if roots[p] == x]
        assert any(jaccard(a, r[1]) >= 0.7 for a in own for r, p in zip(table, prints) if roots[p] != x)
    got = stages["decontamination"](spark, docs, str(tmp_path))
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    clean = lambda x: not any(tuple(w[p : p + len(b)]) == b for w in [words(x)] for b in bench for p in range(len(w) - len(b) + 1))
    assert got.columns == docs.columns and count(got) == Counter((r[0], r[1], r[3]) for r in table if clean(r[1]))
    got = stages["mix"](spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    have, most = count(got), Counter((r[0], r[1], r[3]) for r in table)
    assert all(n <= 3 * most[k] for k, n in have.items())
    size = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))
    taken = mixing.mix(docs).groupBy("source").agg(F.sum("taken")).collect()
    longest = max(size(r[1]) for r in table)
    for r in taken:
        assert abs(sum(size(t) * n for (_, t, src), n in have.items() if src == r[0]) - r[1]) <= longest / 2
    got = stages["shards"](spark, docs, str(tmp_path))
    assert set(docs.columns) <= set(got.columns) and count(got) == most
    shard = {r["doc_id"]: r["shard"] for r in sharding.sharded_documents(docs).collect()}
    seen = {}
    for r in got.collect():
        assert r["shard"] == shard[r["doc_id"]]
        seen.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in seen.values())


def test_pipeline(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = c.run(spark, sf).toPandas()
    assert len(out) and set(docs.columns) <= set(out.columns) and out.shard.between(0, 23).all()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(text[i] == t for i, t in zip(out.doc_id, out.text))
    kept_ids = set(out.doc_id)
    roots = brute_components([brute_simhash(t) for t in text.values()])
    assert max(Counter(roots[brute_simhash(text[i])] for i in kept_ids).values()) == 1
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.decontaminate(docs, bench).filter("contaminated").filter(F.col("doc_id").isin([int(i) for i in kept_ids])).count() == 0
