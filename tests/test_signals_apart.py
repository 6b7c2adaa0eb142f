"""Overlaps in chunks, aligned matches, the near index, uploads, spectrograms and the recordings source against plain versions."""

import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoline.functions import series, views
from echoline.operators import invariants, nearindex, overlap
from echoline.sources import connector, uploads

# --- overlaps -----------------------------------------------------------------------------------------------------


def plain_overlap(q, r):
    """(offset, correlation) of the best offset by one direct correlation after another."""
    best = None
    for k in range(len(r) - len(q) + 1):
        w = r[k : k + len(q)]
        if np.ptp(w) > 0 and np.ptp(q) > 0:
            a, b = q - q.mean(), w - w.mean()
            c = a @ b / np.sqrt((a @ a) * (b @ b))
            if best is None or round(abs(c), 12) > round(abs(best[1]), 12):
                best = k, c
    return best


@pytest.mark.parametrize("chunk", [7, 32, 100, 1 << 16])
def test_chunks_give_the_same_overlap_as_whole_recordings(spark, chunk):
    rng = np.random.default_rng(chunk)
    record = np.round(rng.normal(size=230), 2)
    record[60:90] = 0.5  # a constant stretch
    queries = {f"q{k}": record[k : k + 25] * 2 - 1 for k in (0, 20, 31, 95, 128, 205)} | {"noise": rng.normal(size=11), "flat": np.ones(9), "long": rng.normal(size=231)}
    records = {"r": record, "twice": np.tile(record[100:150], 4), "short": record[:25]}
    q = spark.createDataFrame([(k, v.tolist()) for k, v in queries.items()], "query string, samples array<double>")
    pieces = [(n, a, r[a : a + 13].tolist()) for n, r in records.items() for a in range(0, len(r), 13)]
    parts = spark.createDataFrame(pieces, "record string, start long, samples array<double>").repartition(5)
    whole = spark.createDataFrame([(k, v.tolist()) for k, v in records.items()], "record string, samples array<double>")
    for given in (parts, whole):
        got = {(r["query"], r["record"]): r for r in overlap.sliding_overlap(q, given, per_block=4, chunk=chunk, query_bytes=900).collect()}
        assert len(got) == len(queries) * len(records)
        for (name, rec), r in got.items():
            want = plain_overlap(queries[name], records[rec])
            if want is None:
                assert r["correlation"] is None and r["reason"] == ("constant_query" if name == "flat" else "length")
            else:
                assert (r["offset"], r["reason"]) == (want[0], None) and r["correlation"] == pytest.approx(want[1], abs=1e-9)
    flat = next(r for k, r in got.items() if k == ("q0", "r"))
    assert flat["unassessable"] == 6  # offsets whose 25 samples lie in the constant 30


def test_no_queries_or_recordings(spark):
    q = spark.createDataFrame([("a", [1.0, 2.0, 4.0])], "query string, samples array<double>")
    r = spark.createDataFrame([], "record string, samples array<double>")
    assert overlap.sliding_overlap(q, r).collect() == [] and overlap.sliding_overlap(q.limit(0), q.withColumnRenamed("query", "record")).collect() == []


def test_recordings_are_dealt_over_tasks_and_told_at_once(spark):
    """Little data is much work here: small recordings don't end up in one task, and their pairs need no aggregate; long ones do."""
    x = np.random.default_rng(8).normal(size=(40, 64))
    rows = [(str(i), v.tolist()) for i, v in enumerate(x)]
    q, r = spark.createDataFrame(rows[::4], "query string, samples array<double>"), spark.createDataFrame(rows, "record string, samples array<double>")
    got = overlap.sliding_overlap(q, r)
    assert got.count() == 400 and got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    at_once = {(b["query"], b["record"]): b for b in got.collect()}
    for b in overlap.sliding_overlap(q, r, chunk=32).collect():
        assert b["offset"] == at_once[b["query"], b["record"]]["offset"] == 0 and b["correlation"] == pytest.approx(at_once[b["query"], b["record"]]["correlation"])


@pytest.mark.parametrize("tile", [3, 512])
def test_best_offsets_of_products_are_those_of_transforms(monkeypatch, tile):
    """Equal offsets to the first, constant stretches, queries that differ from a stretch by less than single precision tells."""
    monkeypatch.setattr(overlap, "TILE", tile)
    monkeypatch.setattr(overlap, "MET", 5)
    rng = np.random.default_rng(tile)
    record = np.concatenate([np.tile(rng.normal(size=20), 5), np.full(30, 0.25), rng.normal(size=60)])
    q = np.stack([record[7:23], record[150:166], -record[41:57], record[7:23] + rng.normal(size=16) * 1e-7, *rng.normal(size=(9, 16))])
    found, good = overlap.correlations(q, record)
    at, best = overlap.best_offsets(overlap.unit(q), record, good)
    assert at.tolist() == np.round(found, overlap.DECIMALS).argmax(axis=1).tolist() and at[:4].tolist() == [7, 150, 1, 7]
    assert np.abs(best) == pytest.approx(found.max(axis=1), abs=1e-9) and best[2] == pytest.approx(-1)
    assert overlap.best_offsets(overlap.unit(q), np.ones(50), np.zeros(35, bool))[0].tolist() == [-1] * 13


def test_aligned_matches(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 8))
    x[2] = 0.0
    clips = {f"c{i}": v for i, v in enumerate(x)} | {"same": x[1]}
    record = np.concatenate([x[3], x[1], x[1] * 4, -x[0] * 0.5, [-0.0] * 8, x[5] + 0.0, x[4][:5]])
    shifted = np.concatenate([x[1][:3], x[1], x[0]])
    make = lambda rows, k: spark.createDataFrame([(n, v.tolist()) for n, v in rows.items()], f"{k} string, samples array<double>")
    clips_df, records_df = make(clips, "clip"), make({"r": record, "s": shifted}, "record")
    want = set()
    for n, c in clips.items():
        for rec, r in (("r", record), ("s", shifted)):
            for at in range(0, len(r) - 7, 8):
                a, b = c - c.mean(), r[at : at + 8] - r[at : at + 8].mean()
                if (c == r[at : at + 8]).all():
                    want.add((n, rec, at, overlap.KINDS[0]))
                if np.any(a) and np.any(b) and (a / np.sqrt((a * a).sum()) == b / np.sqrt((b * b).sum())).all():
                    want.add((n, rec, at, overlap.KINDS[1]))
    got = overlap.aligned_matches(clips_df, records_df, 8).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and ("c1", "r", 16, overlap.KINDS[1]) in want and ("c2", "r", 32, overlap.KINDS[0]) in want
    pieces = spark.createDataFrame([("r", a, record[a : a + 16].tolist()) for a in range(0, len(record), 16)], "record string, start long, samples array<double>")
    assert {tuple(r) for r in overlap.aligned_matches(clips_df, pieces, 8).collect()} == {w for w in want if w[1] == "r"}
    classes = overlap.aligned_classes(clips_df, records_df, 8).collect()
    assert sum(c["clips"] * c["windows"] for c in classes) == len(want)


# --- near pairs ---------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("part", [2048, 16])
def test_the_index_finds_what_the_blocks_find(spark, part):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    x = np.repeat(centres, 10, axis=0) + rng.normal(size=(400, 24)) * rng.choice([0.2, 0.5, 0.8], size=(400, 1))
    x[7], x[13], x[399] = 0, x[12], x[12]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)
    exact = {(r["a"], r["b"]): r["cosine"] for r in overlap.near_pairs(df, 0.7, block=64).collect()}
    rows = nearindex.near_pairs(df, 0.7, part=part).collect()
    found = {(r["a"], r["b"]): r["cosine"] for r in rows}
    assert len(found) == len(rows) and all(found[k] == pytest.approx(exact[k]) for k in found)
    assert found.keys() >= {(12, 13), (12, 399)}
    least = {13: 12, 399: 12}  # equal vectors stand for each other
    wanted = {tuple(sorted((least.get(a, a), least.get(b, b)))) for a, b in exact}
    wanted = {k for k in wanted if k[0] != k[1]} | {(12, 13), (12, 399)}
    assert len(wanted & found.keys()) / len(wanted) > 0.995 and not found.keys() - wanted
    few = {(r["a"], r["b"]) for r in nearindex.near_pairs(df, 0.7, tables=8, part=part).collect()}
    assert 0.3 < len(few & wanted) / len(wanted) < 1  # fewer tables miss more: the tables decide the recall


def test_copies_of_a_vector_in_the_buckets_are_fixed(spark):
    x = np.random.default_rng(1).normal(size=(300, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    per = nearindex.keyed(nearindex.sketched(df, 20, 6), 20, 6).groupBy("id").count()
    assert {r["count"] for r in per.collect()} == {20}


def test_log_spectra_and_centring(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 500)) * 300
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(12, None), (13, [float("nan")] * 9)], "id long, x array<double>")
    spectra = df.select("id", series.log_spectrum(512, 64)("x").alias("x"))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)
    padded = np.zeros((12, 32 + 512 + 32))
    padded[:, 32:532] = x
    frames = np.stack([padded[:, k : k + 64] for k in range(0, 513, 32)], axis=2)
    dft = np.exp(-2j * np.pi * np.outer(np.arange(33), np.arange(64)) / 64)
    want = np.log1p(np.abs(np.einsum("fj,njt->nft", dft, frames * window[None, :, None])) / window.sum()).reshape(12, -1)
    got = {r["id"]: r["x"] for r in spectra.collect()}
    assert got[12] is None and got[13] is None and np.allclose([got[i] for i in range(12)], want)
    centred = {r["id"]: np.array(r["x"]) for r in nearindex.double_centred(spectra.repartition(3)).collect()}
    f = want - want.mean(axis=0)
    f -= f.mean(axis=1, keepdims=True)
    f /= np.linalg.norm(f, axis=1, keepdims=True) + 1e-9
    assert set(centred) == set(range(12)) and np.allclose([centred[i] for i in range(12)], f)


def test_near_duplicates_are_an_invariant_of_the_folds(spark):
    rows = [(1, "train"), (2, "test"), (3, "test"), (4, "train")]
    clips = spark.createDataFrame([(i, f, "leak", f"d{i}", f"b{i}", "m", "r", "NA", "NA") for i, f in rows], "clip_id long, fold string, cls string, digest string, body string, material string, region string, pressure string, flow string")
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (1, 4, 0.75)], "a long, b long, cosine double")
    got = {r["name"]: r for r in invariants.fold_invariants(clips, pairs).collect()}
    assert (got["near_duplicate"]["passed"], got["near_duplicate"]["coverage"], got["near_duplicate"]["failures"]) == (False, 4, 1)
    apart = invariants.near_copies_apart(pairs.filter("a = 2"), clips).first()
    assert apart["passed"] and apart["failures"] == 0


# --- uploads and views ----------------------------------------------------------------------------------------------
def riff(x, rate=16000, channels=1, tag=1, bits=16, extensible=False, more=b"", cut=0, size=None):
    """A WAV file of integers or floats, with an odd chunk before its data if ``more`` is given."""
    raw = x.astype("<f4").tobytes() if tag == 3 else (x.astype("<i4") << 8).view(np.uint8).reshape(-1, 4)[:, 1:].tobytes() if bits == 24 else x.astype(f"<i{bits // 8}").tobytes()
    block = channels * bits // 8
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else tag, channels, rate, rate * block, block, bits)
    if extensible:
        fmt += struct.pack("<HHIH", 22, bits, 0, tag) + uploads.SUBFORMAT
    odd = b"LIST" + struct.pack("<I", len(more)) + more + b"\0" * (len(more) % 2) if more else b""
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + odd + b"data" + struct.pack("<I", len(raw) if size is None else size) + raw
    whole = b"RIFF" + struct.pack("<I", len(body)) + body
    return whole[: len(whole) - cut]


def test_uploads_of_every_subtype(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.integers(-30000, 30000, 400)
    floats = (x / 32768).astype(np.float32)
    files = {
        "pcm16": riff(x), "pcm24": riff(x << 8, bits=24), "pcm32": riff(x.astype(np.int64) << 16, bits=32), "float": riff(floats, tag=3, bits=32),
        "ext16": riff(x, extensible=True), "extfloat": riff(floats, tag=3, bits=32, extensible=True, more=b"odd"), "stereo": riff(x, channels=2, more=b"even"),
        "silent": riff(np.zeros(10)), "loud": riff(np.array([-32768, 3])), "above": riff(np.array([1.5, 0], np.float32), tag=3, bits=32),
    }
    bad = {
        "text": (b"not a wave", "not_wav"), "bits8": (riff(x, bits=8), "subtype"), "alaw": (riff(x, tag=6), "subtype"), "three": (riff(x[:399], channels=3), "channels"), "slow": (riff(x, rate=4000), "sample_rate"),
        "none": (riff(x[:0]), "duration"), "long": (riff(np.zeros(8000 * 31), rate=8000), "duration"), "cut": (riff(x, cut=6), "truncated"), "claims": (riff(x, size=4000), "truncated"),
        "nan": (riff(np.array([np.nan, 1], np.float32), tag=3, bits=32), "not_finite"), "inf": (riff(np.array([np.inf, 1], np.float32), tag=3, bits=32), "not_finite"),
        "headless": (b"RIFF\x04\0\0\0WAVE", "not_wav"), "guid": (riff(x, extensible=True).replace(uploads.SUBFORMAT, b"\1" * 14), "subtype"), "large": (b"x" * (uploads.MAX_BYTES + 1), "too_large"),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    for name, (data, _) in bad.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    (tmp_path / "song.mp3").write_bytes(files["pcm16"])
    (tmp_path / "z_copy.WAV").write_bytes(files["pcm16"])
    got = {r["path"].rsplit("/", 1)[1].split(".")[0]: r for r in uploads.read_uploads(spark, f"file://{tmp_path}").collect()}
    assert {n: got[n]["problem"] for n in bad} == {n: why for n, (_, why) in bad.items()} and got["song"]["problem"] == "extension"
    for name in ("pcm16", "pcm24", "pcm32", "float", "ext16", "extfloat"):
        r = got[name]
        assert r["problem"] is None and (r["sample_rate_hz"], r["channels"], r["duration_seconds"]) == (16000, 1, 400 / 16000)
        assert r["waveform"] == floats.tolist() and r["input_sha256"] == hashlib.sha256(b"16000:1:" + floats.tobytes()).hexdigest() and r["sample_id"] == r["input_sha256"][:24]
    assert got["stereo"]["channels"] == 2 and got["stereo"]["sample_id"] != got["pcm16"]["sample_id"] and got["stereo"]["duration_seconds"] == 200 / 16000
    assert got["silent"]["warnings"] == [uploads.SILENT] and got["loud"]["warnings"] == got["above"]["warnings"] == [uploads.FULL_SCALE] and got["pcm16"]["warnings"] == []
    kept = {r["path"].rsplit("/", 1)[1]: r["sent"] for r in uploads.kept(uploads.read_uploads(spark, f"file://{tmp_path}")).collect()}
    assert kept["ext16.wav"] == 7 and "pcm16.wav" not in kept and len(kept) == 5
    m = uploads.read_uploads(spark, f"file://{tmp_path}").filter("problem is null").select("path", uploads.mono(F.col("waveform"), F.col("channels")).alias("m")).collect()
    mono = {r["path"].rsplit("/", 1)[1]: r["m"] for r in m}
    assert np.allclose(mono["stereo.wav"], floats.astype(float).reshape(-1, 2).mean(axis=1)) and mono["pcm16.wav"] == floats.astype(float).tolist()


def plain_view(x, rate):
    """The display by loops over groups."""
    blocks = np.array_split(x, min(800, len(x)))
    n = min(1024, len(x))
    hop = max(1, n // 4)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(1)
    starts = range(0, len(x) - n + 1, hop)
    power = np.abs(np.stack([np.fft.rfft(x[s : s + n] * w) for s in starts], axis=1) / w.sum()) ** 2
    times, freqs = np.array([(s + n / 2) / rate for s in starts]), np.arange(n // 2 + 1) * rate / n
    fg, tg = np.array_split(np.arange(len(freqs)), min(256, len(freqs))), np.array_split(np.arange(len(times)), min(400, len(times)))
    cells = np.array([[power[np.ix_(f, t)].mean(axis=0).mean() for t in tg] for f in fg])
    return [b.min() for b in blocks], [b.max() for b in blocks], [times[g].mean() for g in tg], [freqs[g].mean() for g in fg], 10 * np.log10(np.maximum(cells, 1e-12))


@pytest.mark.parametrize("n", [1, 2, 3, 257, 1000, 1024, 1357, 60_001, 120_000])
def test_spectrograms_are_pooled_before_decibels(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    r = spark.createDataFrame([(x.tolist(), 16000), (None, 1), ([], 1)], "x array<double>, r int").select(views.view()("x", "r").alias("v")).collect()
    assert r[1]["v"]["power_db"] is None and r[2]["v"]["lo"] is None
    got, (lo, hi, times, freqs, db) = r[0]["v"], plain_view(x, 16000)
    assert got["lo"] == lo and got["hi"] == hi and np.allclose(got["times"], times) and np.allclose(got["frequencies_hz"], freqs)
    assert np.shape(got["power_db"]) == db.shape and db.shape[0] <= 256 and db.shape[1] <= 400 and np.abs(np.array(got["power_db"]) - db).max() <= 0.0051
    assert got["block_times"] == (np.linspace(0, n, len(lo) + 1, dtype=int)[:-1] / 16000).tolist()


# --- the recordings source ------------------------------------------------------------------------------------------
def test_recordings_are_pruned_by_fold(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows, sounds = [], {}
    for i in range(20):
        fold = ("train", "validation", "test")[i % 3]
        sounds[i] = rng.integers(-2000, 2000, (900, 8000, 8100)[i % 3] if i else 8000)
        (tmp_path / f"c{i}.wav").write_bytes(riff(sounds[i] if i != 4 else np.zeros(8000), rate=8000) if i != 5 else b"broken")
        rows.append((f"c{i}", f"g{i // 2}", ("leak", "no_leak")[i % 2], fold, f"c{i}.wav"))
    rows += [("gone", "g", "leak", "train", "gone.wav"), ("out", "g", "leak", "train", "../out.wav"), ("nofold", "g", "leak", None, "c1.wav")]
    split = spark.createDataFrame(rows, "clip_id string, group_id string, label string, fold string, path string").coalesce(1)
    connector.publish(split, f"{tmp_path}/manifest", per_file=4)
    r = connector.recordings(spark, f"file://{tmp_path}/manifest", f"file://{tmp_path}")
    got = {x["record_id"]: x for x in r.collect()}
    assert set(got) == {x[0] for x in rows}
    assert {k: v["problem"] for k, v in got.items() if v["problem"]} == {"c5": "not_wav", "gone": "missing", "out": "path"}
    for i in (0, 1, 2, 7, 8):
        whole = np.zeros(8000)
        whole[: min(8000, len(sounds[i]))] = sounds[i][:8000] / 32768
        whole -= whole.mean()
        assert np.allclose(got[f"c{i}"]["samples"], whole / np.sqrt((whole**2).mean()))
    assert not any(got["c4"]["samples"]) and got["c3"]["subject_id"] == "g1" and got["c3"]["fold"] == "train" and got["nofold"]["fold"] is None
    test = r.filter("fold = 'test'")
    assert {x["record_id"] for x in test.collect()} == {x[0] for x in rows if x[3] == "test"}
    everything, some, two = (d.rdd.getNumPartitions() for d in (r, test, r.filter(F.col("fold").isin("test", "validation"))))
    assert some < two < everything and some == 2
    assert r.filter("fold = 'other'").collect() == [] and r.filter("fold = 'test' and label = 'leak'").count() == sum(x[3] == "test" and x[2] == "leak" for x in rows)
    per = {(x["fold"], x["label"]): (x["records"], x["problems"]) for x in connector.counted(r).collect()}
    assert per["train", "leak"] == (6, 2) and sum(n for n, _ in per.values()) == len(rows)
    with pytest.raises(Exception, match="manifest"):
        spark.read.format("recordings").option("root", "x").load().collect()
