"""Live runs over files and the clock, one micro-batch after another."""

import json
import os
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from eventweave.operators.actors import ColumnarActor, Component, RowActor, echo
from eventweave.plans.run import Mode, Run, RunFailed, Status
from eventweave.session import scratch_mark
from eventweave.sources import HeartbeatSource, JsonlSource
from eventweave.sources.sinks import CallbackSink, FrameSink, JsonlSink, ParquetSink
from eventweave.streaming.live import LiveRun, live_jsonl, running_counts
from eventweave.topics import HEART_BEAT, TEXT_MESSAGE, Topic

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
ONE, ECHO, SECOND, BEATS = Topic("one", TEXT_MESSAGE), Topic("echo", TEXT_MESSAGE), Topic("second", TEXT_MESSAGE), Topic("beats", HEART_BEAT)


def feed(folder, batches):
    folder.mkdir()
    for i, rows in enumerate(batches):
        path = folder / f"{i:03}.jsonl"
        path.write_text("\n".join(json.dumps({"msgKey": k, "msgTime": t, "text": "x"}) for k, t in rows) + "\nbroken")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def take(spark, run, folder, path):
    live = LiveRun(run, str(path))
    live.start(live_jsonl(spark, ONE, folder), available_now=True)
    return live, live.wait(timeout_s=300)


def test_arrival_order_window_and_cutoff(spark, tmp_path):
    folder = feed(tmp_path / "in", [[("A", 50), ("A", 5), ("B", 20)], [("A", 10), ("A", 101), ("A", 30)], [("A", 40)]])
    run = Run(10, 100).sink(FrameSink("all"), ONE).actor(ColumnarActor("b", {ONE: ["B"]})).actor(echo("e", ONE, ECHO, keys=["A"])).sink(JsonlSink("echoes", str(tmp_path / "out")), ECHO)
    mark = scratch_mark(spark)
    live, status = take(spark, run, folder, tmp_path / "run")
    got = live.deliveries(spark).sort("pos", "target_ord").select("pos", "topic", "t", "target").collect()
    assert [(r.pos, r.topic, r.t, r.target) for r in got] == [
        (1, "one", 50, "all"), (1, "one", 50, "e"), (2, "one", 20, "all"), (2, "one", 20, "b"), (3, "echo", 50, "echoes"), (4, "one", 10, "all"), (4, "one", 10, "e"), (5, "echo", 10, "echoes"),
    ]
    assert status is run.status is Status.COMPLETE and scratch_mark(spark) == mark
    assert [json.loads(r.value)["msgTime"] for r in spark.read.text(str(tmp_path / "out") + "/batch=*").collect()] == [50, 10]


class Totals(Component):
    """Counts over all batches; says so with each event, and at its end to a file."""

    def __init__(self, path):
        self.path, self.n = path, 0

    def on_startup(self, start_ms):
        self.note(f"start {start_ms}")

    def on_event(self, topic, payload):
        self.n += 1
        if payload["text"] == "fails":
            raise RuntimeError("no")
        self.publish("echo", {"msgKey": payload["msgKey"], "msgTime": payload["msgTime"] - (payload["msgKey"] == "late"), "text": str(self.n)})

    def on_shutdown(self, last_ms):
        self.note(f"stop {last_ms} {self.n}")

    def on_abort(self):
        self.note("abort")

    def note(self, what):
        with open(self.path, "a") as f:
            f.write(what + "\n")


@pytest.mark.parametrize("by_key", [False, True])
def test_row_actors_keep_their_state_and_chains_run_whatever_the_order(spark, tmp_path, by_key):
    folder = feed(tmp_path / "in", [[("A", 50), ("B", 20)], [("late", 30)], [("A", 60), ("A", 70)]])
    log = str(tmp_path / "log")
    # "two" hears what "one" publishes and is registered before it.
    run = Run(10, 100).actor(echo("two", ECHO, SECOND)).actor(RowActor("one", {ONE: None}, {ECHO: None}, make=lambda: Totals(log), by_key=by_key)).sink(ParquetSink("s", str(tmp_path / "pq")), SECOND)
    live, _ = take(spark, run, folder, tmp_path / "run")
    echoes = [(r.key, r.t, json.loads(r.json)["text"]) for r in live.deliveries(spark).where("target = 'two'").sort("pos").collect()]
    assert echoes == ([("A", 50, "1"), ("B", 20, "1"), ("A", 60, "2"), ("A", 70, "3")] if by_key else [("A", 50, "1"), ("B", 20, "2"), ("A", 60, "4"), ("A", 70, "5")])
    assert [r.t for r in live.deliveries(spark).where("target = 's'").sort("pos").collect()] == [50, 20, 60, 70] and spark.read.parquet(str(tmp_path / "pq")).count() == 4
    assert sorted(r.kind for r in live.errors(spark).collect()) == ["error", "reject"]
    lines = sorted(open(log).read().split("\n")[:-1])
    assert lines == (["start 10"] * 3 + ["stop 70 1"] * 2 + ["stop 70 3"] if by_key else ["start 10", "stop 70 5"])


def test_failing_sink_stops_a_live_run(spark, tmp_path):
    log = str(tmp_path / "log")

    def handler():
        def handle(kind, topic, text, t):
            with open(log, "a") as f:
                f.write(f"{kind}\n")
            if t == 60:
                raise RuntimeError("sink")

        return handle

    for last, want in ((70, ["START", "DATA", "DATA", "STOP", "END"]), (60, ["START", "DATA", "DATA", "END"])):
        open(log, "w").close()
        where = tmp_path / str(last)
        where.mkdir()
        folder = feed(where / "in", [[("A", 50)], [("A", last)]])
        run = Run(10, 100).actor(RowActor("c", {ONE: None}, {ECHO: None}, make=lambda where=where: Totals(str(where / "c")))).sink(CallbackSink("s", handler), ONE)
        if last == 70:
            assert take(spark, run, folder, where / "run")[1] is Status.COMPLETE
        else:
            with pytest.raises(RunFailed):
                take(spark, run, folder, where / "run")
            assert run.status is Status.STOPPED and open(where / "c").read().split("\n")[-2] == "abort"
        assert open(log).read().split() == want


def test_pause_and_resume(spark, tmp_path):
    folder = feed(tmp_path / "in", [[("A", 50)], [("A", 60)]])
    run = Run(10, 100).actor(RowActor("c", {ONE: None}, {ECHO: None}, make=lambda: Totals(str(tmp_path / "log")))).sink(FrameSink("s"), ECHO)
    live = LiveRun(run, str(tmp_path / "run"))
    query = live.start(live_jsonl(spark, ONE, folder), available_now=True)
    query.awaitTermination(120)
    live.pause()
    assert run.status is Status.PAUSED
    feed(tmp_path / "more", [[("A", 70)]])
    (tmp_path / "more" / "000.jsonl").rename(tmp_path / "in" / "002.jsonl")
    live.resume()
    assert live.wait(timeout_s=120) is Status.COMPLETE
    assert [json.loads(r.json)["text"] for r in live.deliveries(spark).where("target = 's'").sort("pos").collect()] == ["1", "2", "3"]


def test_heartbeats_come_at_their_time_and_end_the_run(spark, tmp_path):
    now = int(time.time() * 1000)
    start, end = now - 50, now + 4_000
    run = Run(start, end).source(HeartbeatSource("hb", {BEATS: None}, "BEAT", 500, start)).sink(FrameSink("s"), BEATS)
    assert run.mode is Mode.REAL_TIME
    live = run.launch(spark, str(tmp_path / "run"))
    assert live.wait(lead_ms=6_000, timeout_s=60) is Status.COMPLETE
    got = [r.t for r in live.deliveries(spark).sort("pos").collect()]
    assert got == list(range(start, end + 1, 500))
    for r in spark.read.parquet(str(tmp_path / "run" / "arrived")).collect():
        assert r.arrived_ms >= r.t


def test_launch_replays_what_is_over(spark, tmp_path):
    folder = feed(tmp_path / "in", [[("A", 50), ("B", 60)]])
    run = Run(10, 100).source(JsonlSource("r", {ONE: None}, folder)).sink(FrameSink("s"), ONE)
    assert run.launch(spark, str(tmp_path / "run")).status is Status.COMPLETE


def test_counts_over_batches(spark, tmp_path):
    folder = feed(tmp_path / "in", [[("A", 1), ("A", 2), ("B", 3)], [("A", 4)]])
    counts = running_counts(live_jsonl(spark, ONE, folder))
    query = counts.writeStream.format("memory").queryName("live_counts").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.key, r.seen, r.last_t) for r in spark.table("live_counts").where(F.col("topic") == "one").collect()}
    assert got == {("A", 2, 2), ("B", 1, 3), ("A", 3, 4)}
