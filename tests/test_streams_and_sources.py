"""Stateful tracking, WAV source and feature families against small plain versions."""

import io
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echoline.functions import features
from echoline.sources import wav
from echoline.streaming import replay, tracker


def window(seq, p, session="s", **more):
    return {"session": session, "seq": seq, "end": 101.0 + seq, "received": 101.0 + seq, "digest": "a" * 64, "p": p, "problem": None if p is not None else "silence"} | more


def run(spark, tmp_path, *batches):
    """Feed batches as files to one streaming query and give back its outcomes."""
    source, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    for rows in batches:
        pdf = pd.DataFrame(rows)
        spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), tracker.ROWS).coalesce(1).write.mode("append").json(source)
        stream = tracker.track_stream(spark.readStream.schema(tracker.ROWS).json(source))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    return spark.read.parquet(out).orderBy("session", "seq").collect()


def test_open_close_and_restart(spark, tmp_path):
    first = [window(i, 0.9) for i in range(4)] + [window(i, 0.9, "t") for i in range(2)]
    second = [window(3, 0.9), window(4, 0.9, digest="b" * 64)] + [window(5 + i, 0.2) for i in range(5)] + [window(4, 0.9, "t")]
    got = run(spark, tmp_path, first, second)
    kinds = [(r["session"], r["seq"], r["kind"]) for r in got if r["kind"]]
    assert kinds == [("s", 2, "opened"), ("s", 9, "ended")]
    assert [r["seq"] for r in got if r["outcome"] == "duplicate"] == [3]
    end = next(r for r in got if r["kind"] == "ended")
    assert (end["observed"], end["high"], end["interrupted"]) == (10, 5, False)
    assert not [r for r in got if r["session"] == "t" and r["kind"]]


def test_duplicate_gets_the_first_answer_again(spark, tmp_path):
    """Also in a later batch, after a rejected row, and outside of an event."""
    rows = [window(0, 0.1), window(0, 0.1)] + [window(i, 0.9) for i in range(1, 4)]
    got = run(spark, tmp_path, rows, [window(3, 0.9, digest="b" * 64, received=104.1), window(3, 0.9, received=104.2)])
    answer = lambda r: (r["event"], r["observed"], r["high"], r["interrupted"])
    by = {(r["seq"], r["outcome"]): r for r in got}
    assert by[3, "accepted"]["kind"] == by[3, "duplicate"]["repeats"] == "opened" and by[3, "duplicate"]["kind"] is None
    assert answer(by[3, "accepted"]) == answer(by[3, "duplicate"]) == (1, 3, 3, False) and by[3, "rejected"]["reason"] == "conflict"
    assert answer(by[0, "duplicate"]) == (None,) * 4 and by[0, "duplicate"]["repeats"] is None


def test_rejections_gaps_and_persistence():
    s = dict(zip(tracker.FIELDS, tracker.START))
    take = lambda w: tracker.refused(s, pd.Series(w)) or tracker.advance(s, pd.Series(w))
    assert [take(window(i, 0.9)) for i in range(3)] == [None, None, "opened"]
    assert take(window(2, 0.9, digest="b" * 64)) == "conflict" and take(window(1, 0.9)) == "old"
    assert take(window(3, 0.9, received=90.0)) == "future" and take(window(3, 0.9, received=120.0)) == "stale"
    assert take(window(3, 0.9, end=105.5, received=105.5)) == "cadence" and take(window(3, 1.5)) == "score"
    assert take(window(3, None, problem=None)) == "abstention without a reason"
    assert take(window(5, 0.9)) is None and s["interrupted"] and s["current"] == 1
    assert [take(window(i, 0.9)) for i in range(6, 36)] == [None] * 29 + ["persistent"]
    assert take(window(36, None)) is None and s["current"] == 0
    assert [take(window(i, 0.2)) for i in range(37, 42)] == [None] * 4 + ["ended"]


def wav_bytes(samples, rate=8000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(samples.dtype.itemsize), w.setframerate(rate)
        w.writeframes(samples.tobytes())
    return out.getvalue()


def test_read_wav(spark, tmp_path):
    good = (np.sin(np.arange(8000)) * 10000).astype("<i2")
    files = {"a": wav_bytes(good), "b": wav_bytes(good.astype("<i4") << 16), "c": wav_bytes(good[:-1]), "d": b"RIFFnothing", "e": wav_bytes(good, 16000), "f": wav_bytes(good, 8000, 2), "h": wav_bytes(good)[:-10]}
    for name, data in files.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    got = {r["path"][-5]: r for r in wav.read_wav(spark, f"file://{tmp_path}").collect()}
    assert {k: r["problem"] for k, r in got.items()} == {"a": None, "b": None, "c": "length", "d": "not_wav", "e": "sample_rate", "f": "channels", "h": "length"}
    assert wav.decoded(b"", 8000, 8000) == (None, "not_wav") and wav.decoded(None, 8000, 8000) == (None, "missing")
    assert np.allclose(got["a"]["samples"], good / 32768) and got["a"]["samples"] == got["b"]["samples"]
    row = spark.createDataFrame([([1.0, 2.0],)], "x array<double>").select(wav.fitted(F.col("x"), 4).alias("long"), wav.fitted(F.col("x"), 1).alias("short")).first()
    assert row["long"] == [1, 2, 0, 0] and row["short"] == [1]


def test_feature_families(spark):
    rng = np.random.default_rng(0)
    noise, tone = rng.normal(0, 100, 8000), 1000 * np.sin(2 * np.pi * 750 * np.arange(8000) / 8000)
    beat = tone * (1 + np.sin(2 * np.pi * 10 * np.arange(8000) / 8000))
    rows = spark.createDataFrame([(0, noise.tolist()), (1, tone.tolist()), (2, beat.tolist()), (3, None), (4, [1.0, float("nan")]), (5, (noise * 3).tolist())], "id int, x array<double>")
    got = {r["id"]: r for r in rows.select("id", *[features.features(f)("x").alias(f) for f in features.FAMILIES]).collect()}
    assert all(v is None for f in features.FAMILIES for i in (3, 4) for v in got[i][f])
    assert got[1]["level"]["rms_dbfs"] == pytest.approx(20 * np.log10(1000 / np.sqrt(2) / 32768), abs=1e-6)
    assert got[1]["spectral"]["centroid_hz"] == pytest.approx(750, abs=1) and got[1]["spectral"]["band_500_1000"] > 0.999
    assert got[0]["spectral"]["flatness"] > 100 * got[1]["spectral"]["flatness"]
    assert got[1]["amplitude"]["crest"] == pytest.approx(np.sqrt(2), abs=1e-3) and got[0]["amplitude"]["kurtosis"] == pytest.approx(3, abs=0.2)
    assert got[2]["dynamics"]["modulation_peak_log_hz"] == pytest.approx(1) and got[2]["dynamics"]["modulation_4_16"] > 0.9
    assert got[1]["mixed"]["zero_crossings"] == pytest.approx(1500 / 8000, abs=0.1)
    for family in ("amplitude", "spectral", "dynamics", "mixed"):
        assert list(got[0][family]) == pytest.approx(list(got[5][family]))
    envelope = np.abs(noise - noise.mean())
    envelope -= envelope.mean()
    full = np.correlate(envelope, envelope, "full")[7999:] / np.arange(8000, 0, -1)
    assert got[0]["dynamics"]["envelope_peak"] == pytest.approx(full[32:2000].max() / full[0])


def test_end_of_session_stops_an_open_event():
    s = dict(zip(tracker.FIELDS, tracker.START))
    take = lambda w: tracker.refused(s, pd.Series(w)) or tracker.advance(s, pd.Series(w))
    assert [take(window(i, 0.9)) for i in range(3)][-1] == "opened"
    last = window(3, None, problem=tracker.END_OF_SESSION)
    assert take(last) == "stopped" and s["interrupted"] and not s["active"]
    assert take(last) == "duplicate" and take(window(4, 0.9)) == "session has ended"


def test_policy_is_locked(spark, tmp_path, monkeypatch):
    tracker.lock_policy(spark, f"{tmp_path}/policy")
    tracker.lock_policy(spark, f"{tmp_path}/policy")
    monkeypatch.setattr(tracker.config, "OPEN_AT", 0.7)
    with pytest.raises(ValueError, match="policy"):
        tracker.lock_policy(spark, f"{tmp_path}/policy")


@pytest.mark.parametrize("cut", [1, 3, 50])
def test_a_replayed_stream_equals_the_whole(spark, tmp_path, cut):
    """The slot of a session goes on from batch to batch, also when the query is started anew between them."""
    rng = np.random.default_rng(cut)
    moments = {s: np.sort(rng.choice(np.arange(40) / 2, 14)) for s in ("a", "b")}
    rows = [(s, float(t), int(q), 0, ("drop" if rng.random() < 0.1 else None), 0.8) for s, ts in moments.items() for q, t in zip(np.argsort(rng.random(14)) // 2 + np.arange(14), ts, strict=True)]
    want = {s: list(replay.deliver(replay._moments(pd.DataFrame([r for r in rows if r[0] == s], columns=["session", "arrival", "seq", "copy", "fault", "busy"])), 0.8)) for s in moments}
    times = sorted({r[1] for r in rows})
    steps = [times[i : i + len(times) // cut + 1] for i in range(0, len(times), len(times) // cut + 1)][:6]
    steps[-1] = [t for t in times if t >= steps[-1][0]]
    source, out, mark = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    for i, step in enumerate(steps):
        part = [r for r in rows if r[1] in step] + ([(s, times[-1], None, 0, replay.END_OF_SESSION, 0.8) for s in moments] if i == len(steps) - 1 else [])
        spark.createDataFrame(part, replay.ARRIVALS).coalesce(1).write.mode("append").json(source)
        stream = replay.replay_stream(spark.readStream.schema(replay.ARRIVALS).json(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    got = {}
    for r in spark.read.parquet(out).orderBy("session", "step").collect():
        got.setdefault(r["session"], []).append((r["at"], r["event"], r["seq"], r["reason"]))
    assert got == {s: [(t, e, int(q), r) for t, e, q, r in log] for s, log in want.items()}
