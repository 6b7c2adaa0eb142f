"""Processing-time timers, restarts under another run, and jobs that are completed once."""

import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from echoline.streaming import incidents, jobs, timers, tracker


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    spark.conf.set(*timers.STORE)
    yield
    spark.conf.unset(timers.STORE[0])


class Runs:
    """One query over a growing folder, started again under another run id from the same checkpoint."""

    def __init__(self, spark, tmp_path, schema, make):
        self.spark, self.schema, self.make = spark, schema, make
        self.source, self.out, self.mark = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
        spark.createDataFrame([], schema).write.mode("append").json(self.source)
        self.query = None

    def feed(self, rows):
        pdf = pd.DataFrame(rows)
        self.spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), self.schema).coalesce(1).write.mode("append").json(self.source)

    def start(self, boot):
        stream = self.make(self.spark.readStream.schema(self.schema).json(self.source), boot)
        self.query = stream.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.mark).outputMode("append").trigger(processingTime="300 milliseconds").start()

    def stop(self):
        self.query.stop()

    def rows(self):
        try:
            return self.spark.read.parquet(self.out).collect()
        except Exception:
            return []

    def wait(self, until, seconds=60):
        end = time.time() + seconds
        while time.time() < end:
            assert self.query.exception() is None, self.query.exception()
            if until(found := self.rows()):
                return found
            time.sleep(0.3)
        raise AssertionError(f"not seen within {seconds} s: {self.rows()}")


def window(seq, p, session="s", **more):
    return {"session": session, "seq": seq, "end": 101.0 + seq, "received": 101.0 + seq, "digest": "a" * 64, "p": p, "problem": None if p is not None else "silence"} | more


def test_a_session_goes_stale_by_its_timer_and_degrades_by_a_restart(spark, tmp_path):
    runs = Runs(spark, tmp_path, tracker.ROWS, lambda rows, boot: timers.session_stream(rows, boot, stale_after=3.0))
    runs.feed([window(i, 0.9) for i in range(4)] + [window(0, 0.1, "t")])
    runs.start("first")
    got = runs.wait(lambda rows: sum(r["outcome"] == "timer" for r in rows) >= 2)
    assert {(r["session"], r["health"], r["reason"]) for r in got if r["outcome"] == "timer"} == {("s", "stale", "silence"), ("t", "stale", "silence")}
    assert [r["kind"] for r in got if r["kind"]] == ["opened"]
    runs.feed([window(4, 0.9), window(1, 0.1, "t")])
    runs.wait(lambda rows: any(r["seq"] == 4 for r in rows))
    runs.stop()
    runs.start("second")  # the timer of the first run fires under the second
    got = runs.wait(lambda rows: any(r["boot"] == "second" and r["outcome"] == "timer" and r["session"] == "s" for r in rows))
    told = next(r for r in got if r["boot"] == "second" and r["outcome"] == "timer" and r["session"] == "s")
    assert (told["health"], told["reason"]) == ("degraded", "restart")
    runs.feed([window(5, 0.9), window(6, 0.9)])
    got = runs.wait(lambda rows: any(r["seq"] == 6 for r in rows))
    runs.stop()
    after = next(r for r in got if r["seq"] == 6)
    assert (after["outcome"], after["health"], after["event"], after["interrupted"]) == ("accepted", "fresh", 1, True)
    assert sum(r["kind"] == "opened" for r in got) == 1


def test_a_row_after_a_restart_starts_runs_again(spark, tmp_path):
    runs = Runs(spark, tmp_path, tracker.ROWS, lambda rows, boot: timers.session_stream(rows, boot, stale_after=3600))
    runs.feed([window(0, 0.9), window(1, 0.9)])
    runs.start("first")
    runs.wait(lambda rows: len(rows) == 2)
    runs.stop()
    runs.feed([window(2, 0.9), window(3, 0.9)])
    runs.start("second")
    got = runs.wait(lambda rows: len(rows) == 4)
    runs.stop()
    assert not [r for r in got if r["kind"]]  # four high windows, but two on either side of the restart


def command(kind, at, source="a", ok=None, detail=None):
    return {"source": source, "at": at, "kind": kind, "ok": ok, "detail": detail}


def test_an_incident_is_dispatched_once_by_its_timer(spark, tmp_path):
    runs = Runs(spark, tmp_path, incidents.COMMANDS, lambda rows, boot: timers.incident_stream(rows, boot, persistence=15.0))
    runs.feed([command("start", 100.0), command("start", 100.0, "b"), command("start", 100.0, "c")])
    runs.start("first")
    runs.wait(lambda rows: len(rows) >= 3)
    assert not [r for r in runs.rows() if r["event"] == "dispatch"]
    runs.feed([command("resolve", 101.0, "b"), command("start", 101.0, "a")])
    runs.wait(lambda rows: {r["source"] for r in rows if r["event"] == "dispatch"} == {"a", "c"})
    runs.feed([command("delivered", 104.0, "a", ok=False, detail="no route"), command("delivered", 104.0, "c", ok=True)])
    runs.wait(lambda rows: any(r["event"] == "alert_sent" for r in rows))
    runs.feed([command("retry", 105.0, "a"), command("retry", 105.0, "c")])
    got = runs.wait(lambda rows: sum(r["event"] == "dispatch" and r["source"] == "a" for r in rows) == 2)
    runs.stop()
    events = lambda s: [r["event"] for r in sorted(got, key=lambda r: (r["attempts"], r["at"])) if r["source"] == s]
    assert events("b") == ["anomaly_started", "resolved"]
    assert events("c").count("dispatch") == 1 and "retry_requested" not in events("c")
    confirmed = next(r for r in got if r["event"] == "persistence_confirmed" and r["source"] == "a")
    assert confirmed["at"] == pytest.approx(115.0)


def test_a_dispatch_under_way_in_a_crash_is_never_sent_again(spark, tmp_path):
    runs = Runs(spark, tmp_path, incidents.COMMANDS, lambda rows, boot: timers.incident_stream(rows, boot, persistence=1.0, watch=25.0))
    runs.feed([command("start", 100.0)])
    runs.start("first")
    runs.wait(lambda rows: any(r["event"] == "dispatch" for r in rows))
    done = runs.query.lastProgress["batchId"] if runs.query.lastProgress else -1
    end = time.time() + 15
    while time.time() < end and (runs.query.lastProgress is None or runs.query.lastProgress["batchId"] <= done + 1):
        time.sleep(0.3)  # the batch that dispatched is over
    runs.stop()
    runs.start("second")
    got = runs.wait(lambda rows: any(r["event"] == "alert_failed" for r in rows))
    failed = next(r for r in got if r["event"] == "alert_failed")
    assert (failed["status"], failed["delivery"], failed["detail"]) == ("failed", "unknown", timers.RESTARTED)
    runs.feed([command("retry", 200.0), command("resolve", 201.0)])
    got = runs.wait(lambda rows: any(r["event"] == "resolved" for r in rows))
    runs.stop()
    assert sum(r["event"] == "dispatch" for r in got) == 1 and not [r for r in got if r["event"] == "retry_requested"]


def test_a_dispatch_without_an_answer_is_given_up(spark, tmp_path):
    runs = Runs(spark, tmp_path, incidents.COMMANDS, lambda rows, boot: timers.incident_stream(rows, boot, persistence=1.0, watch=3.0))
    runs.feed([command("start", 100.0)])
    runs.start("first")
    got = runs.wait(lambda rows: any(r["event"] == "alert_failed" for r in rows))
    runs.stop()
    failed = next(r for r in got if r["event"] == "alert_failed")
    assert (failed["delivery"], failed["detail"]) == ("unknown", timers.UNANSWERED) and sum(r["event"] == "dispatch" for r in got) == 1


PREVIEWS = "event string, what string, value string, history string"


def described(asked):
    """Describes all but the events whose name ends with x."""
    return asked.filter(~F.col("event").endswith("x")).select("event", "what", F.concat(F.lit("seen "), "history").alias("description"), F.lit("template").alias("source"))


class Queue:
    def __init__(self, spark, tmp_path):
        self.spark, self.path = spark, f"{tmp_path}/log"
        self.source, self.marks = f"{tmp_path}/in", {x: f"{tmp_path}/check-{x}" for x in ("tracker", "worker")}
        spark.createDataFrame([], PREVIEWS).write.json(self.source)

    def put(self, *rows):
        self.spark.createDataFrame(rows, PREVIEWS).coalesce(1).write.mode("append").json(self.source)
        rows = self.spark.readStream.schema(PREVIEWS).json(self.source)
        jobs.enqueue(rows, self.path).option("checkpointLocation", self.marks["tracker"]).trigger(availableNow=True).start().awaitTermination(120)

    def work(self):
        jobs.drain(self.spark, self.path, described).option("checkpointLocation", self.marks["worker"]).trigger(availableNow=True).start().awaitTermination(120)

    def of(self, kind):
        return {(r["event"], r["what"]): r["value"] for r in jobs.current(self.spark, self.path, kind).collect()}


def test_jobs_are_completed_with_their_previews(spark, tmp_path):
    q = Queue(spark, tmp_path)
    q.put(("e1", "persistent", "p1", "h1"), ("e1", "ended", "p2", "h2"), ("e2x", "persistent", "p3", "h3"))
    assert set(q.of("job")) == set(q.of("preview")) == {("e1", "persistent"), ("e1", "ended"), ("e2x", "persistent")}
    q.work()
    ready = {k: json.loads(v) for k, v in q.of("preview").items()}
    assert q.of("job") == {} and {v["status"] for v in ready.values()} == {"ready"}
    assert ready["e1", "ended"] == {"preview": "p2", "status": "ready", "description": "seen h2", "description_source": "template"}
    assert ready["e2x", "persistent"]["description"] == jobs.FALLBACK and ready["e2x", "persistent"]["description_source"] == "template_fallback"
    q.put(("e1", "persistent", "other", "other"), ("e3", "persistent", "p4", "h4"))  # the first is known
    q.work()
    ready = {k: json.loads(v) for k, v in q.of("preview").items()}
    assert ready["e1", "persistent"]["preview"] == "p1" and ready["e3", "persistent"]["description"] == "seen h4" and q.of("job") == {}
    jobs.compact(spark, q.path, f"{q.path}-new")
    assert {(r["event"], r["what"]) for r in jobs.current(spark, f"{q.path}-new", "preview").collect()} == set(ready)


@pytest.mark.parametrize("where", ["before the commit", "after the commit"])
def test_a_worker_killed_between_the_writes_completes_once(spark, tmp_path, monkeypatch, where):
    q = Queue(spark, tmp_path)
    q.put(("e1", "persistent", "p1", "h1"), ("e2", "ended", "p2", "h2"))
    commit = jobs._commit

    def killed(session, path, writer, batch):
        if where == "after the commit":
            commit(session, path, writer, batch)
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(jobs, "_commit", killed)
        with pytest.raises(Exception, match="killed"):
            q.work()
    if where == "before the commit":
        assert len(q.of("job")) == 2 and {v for v in q.of("preview").values()} == {"p1", "p2"}  # neither write counts
    q.work()
    assert q.of("job") == {} and {json.loads(v)["status"] for v in q.of("preview").values()} == {"ready"}
    log = spark.read.schema(jobs.LOG).parquet(f"{q.path}/changes").filter("writer = 'worker' and kind = 'preview'")
    assert log.count() == 2


def test_a_tracker_killed_between_the_writes_puts_once(spark, tmp_path, monkeypatch):
    q = Queue(spark, tmp_path)
    with monkeypatch.context() as m:
        m.setattr(jobs, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(Exception, match="killed"):
            q.put(("e1", "persistent", "p1", "h1"))
    assert q.of("job") == {}
    q.put(("e2", "persistent", "p2", "h2"))
    q.work()
    assert set(q.of("preview")) == {("e1", "persistent"), ("e2", "persistent")} and q.of("job") == {}


def test_only_fresh_sessions_with_context_are_described(spark):
    rows = [("a", "fresh", [1] * 31), ("b", "fresh", [1] * 30), ("c", "stale", [1] * 40), ("d", "fresh", None)]
    assert [r["session"] for r in jobs.with_context(spark.createDataFrame(rows, "session string, health string, history array<int>")).collect()] == ["a"]
