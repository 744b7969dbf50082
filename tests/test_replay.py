"""Replay: small topologies with exact sequences, and random ones against a queue model."""

import heapq
import json
import random
import sys
from decimal import Decimal

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from eventweave.functions import codec
from eventweave.operators.actors import ColumnarActor, Component, RowActor, Unbound, echo
from eventweave.operators.merge import monotonic_guard, with_position
from eventweave.operators.routing import RouteConflict
from eventweave.plans.run import Mode, NotOver, Run, RunFailed, Status, mode_of
from eventweave.report import CallbackReporter, ComponentReporter, LoggingReporter, ReportLevel, configure_logging, set_default_reporter
from eventweave.sources import FrameSource, HeartbeatSource, IterableSource, JsonlSource
from eventweave.sources.sinks import CallbackSink, FrameSink, JsonlSink, ParquetSink, PrintSink
from eventweave.topics import CDF_BAR, HEART_BEAT, TEXT_MESSAGE, VECTOR_VALUE, PayloadType, Topic, register

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
S = 1_283_630_000_000
ONE, TWO, HB, ECHO = Topic("one", TEXT_MESSAGE), Topic("two", TEXT_MESSAGE), Topic("hb", HEART_BEAT), Topic("echo", TEXT_MESSAGE)


def messages(name, topic, offsets, key="A"):
    return IterableSource(name, {topic: [key]}, lambda: [(topic.name, {"msgKey": key, "msgTime": S + o, "text": f"{name} {i}"}) for i, o in enumerate(offsets)])


def ordered(df):
    return [(r.topic, r.t - S) for r in df.sort("ord").collect()]


def jsonl(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(path)


def test_three_sources_merge_and_echo(spark, tmp_path):
    one = jsonl(tmp_path / "one.jsonl", [{"msgKey": "A", "msgTime": S + t, "text": "x", "unknown": 1} for t in (0, 2000, 4000, 6000)] + [""])
    two = jsonl(tmp_path / "two.jsonl", [{"msgKey": "A", "msgTime": S + t, "text": "y"} for t in (1000, 3000, 5000, 9000)] + ["broken"])
    run = Run(S, S + 7000).source(JsonlSource("r1", {ONE: ["A"]}, one)).source(JsonlSource("r2", {TWO: ["A"]}, two))
    run.source(HeartbeatSource("beats", {HB: None}, "BEAT", 2000, S + 1500)).actor(echo("echoer", ONE, ECHO)).sink(JsonlSink("out", str(tmp_path / "out"), single_file=True), ECHO)
    result = run.execute(spark)
    want = [("one", 0), ("two", 1000), ("hb", 1500), ("one", 2000), ("two", 3000), ("hb", 3500), ("one", 4000), ("two", 5000), ("hb", 5500), ("one", 6000)]
    assert ordered(result.events.where("topic <> 'echo'")) == want
    assert ordered(result.events.where("topic = 'echo'")) == [("echo", t) for t in (0, 2000, 4000, 6000)]
    assert run.status is Status.COMPLETE and result.last_time == S + 6000
    assert [json.loads(r.value)["msgTime"] - S for r in spark.read.text(str(tmp_path / "out")).collect()] == [0, 2000, 4000, 6000]


def test_ties_and_priority(spark):
    for high, want in ((False, "ABAB"), (True, "BABA")):
        run = Run(S, S + 9000).source(messages("A", ONE, [1000, 2000])).source(messages("B", TWO, [1000, 2000]), high_priority=high)
        assert "".join("A" if t == "one" else "B" for t, _ in ordered(run.plan(spark).events)) == want


def test_guard_drops_backward_times_after_the_window(spark):
    run = Run(S, S + 9000).source(messages("A", ONE, [1000, 20_000, 2000, 1500, 2000, 3000, -5]))
    assert ordered(run.plan(spark).events) == [("one", t) for t in (1000, 2000, 2000, 3000)]
    df = spark.range(0, 2000).select(F.col("id").alias("seq"), ((F.col("id") * 7919) % 2000 + F.col("id")).alias("t"))
    rows, top, want = df.collect(), None, []
    for r in rows:
        if top is None or r.t >= top:
            want.append(r.seq)
            top = r.t
    assert sorted(r.seq for r in monotonic_guard(df, "seq", chunk=64).collect()) == want


def test_positions_over_all_and_within_keys(spark):
    df = spark.range(0, 997).select(F.array((F.col("id") * 31 % 997), F.lit(1).cast("bigint")).alias("ord"), F.when(F.col("id") % 3 > 0, "hot").alias("k"))
    got = with_position(df, partitions=5).collect()
    assert [r.pos for r in sorted(got, key=lambda r: r.ord)] == list(range(1, 998))
    by = with_position(df, by=["k"], partitions=5).collect()
    for k in ("hot", None):
        rows = sorted((r for r in by if r.k == k), key=lambda r: r.ord)
        assert [r.pos for r in rows] == list(range(1, len(rows) + 1))


class Shift(Component):
    def __init__(self, by):
        self.by = by

    def on_event(self, topic, payload):
        self.publish("echo", {"msgKey": "A", "msgTime": payload["msgTime"] + self.by, "text": "x"})


@pytest.mark.parametrize(("by", "kept"), [(-500, []), (0, [1000]), (500, [1500])])
def test_causality(spark, by, kept):
    plan = Run(S, S + 9000).source(messages("A", ONE, [1000])).actor(RowActor("s", {ONE: None}, {ECHO: None}, make=lambda: Shift(by))).plan(spark)
    assert ordered(plan.events.where("topic = 'echo'")) == [("echo", t) for t in kept]
    assert sorted(r.kind for r in plan.errors.collect()) == ([] if kept else ["error", "reject"])


def test_dispatch_order(spark):
    sink = FrameSink("sink")
    run = Run(S, S + 9000).source(messages("A", ONE, [1000])).sink(sink, ONE)
    for name, high in (("a", False), ("b", False), ("c", True), ("d", False), ("e", True)):
        run.actor(ColumnarActor(name, {ONE: ["A"]}, high_priority=high))
    assert [r.target for r in run.plan(spark).deliveries.sort("target_ord").collect()] == ["sink", "c", "e", "a", "b", "d"]
    with pytest.raises(ValueError, match="already"):
        run.actor(ColumnarActor("a", {ONE: None}))
    with pytest.raises(ValueError, match="neither"):
        run.actor(ColumnarActor("idle"))


class Fails(Component):
    def on_event(self, topic, payload):
        raise RuntimeError("no")


def test_failing_actor_is_isolated_and_failing_sink_is_fatal(spark, tmp_path):
    beats = lambda: HeartbeatSource("b", {HB: None}, "BEAT", 2000, S + 1500)
    run = Run(S, S + 6000).source(beats()).actor(RowActor("bad", {HB: None}, make=Fails)).actor(ColumnarActor("good", {HB: None}))
    result = run.execute(spark)
    assert result.errors.where("kind = 'error'").count() == 3 and result.deliveries.where("target = 'good'").count() == 3 and run.status is Status.COMPLETE
    log = str(tmp_path / "log")

    def handler():
        def handle(kind, topic, text, t):
            with open(log, "a") as f:
                f.write(f"{kind}\n")
            if kind == "DATA" and t == S + 3500:
                raise RuntimeError("sink")

        return handle

    bad = Run(S, S + 6000).source(beats()).sink(CallbackSink("s", handler), HB)
    with pytest.raises(RunFailed):
        bad.execute(spark)
    assert bad.status is Status.STOPPED and open(log).read().split() == ["START", "DATA", "DATA", "END"]
    open(log, "w").close()
    soft = Run(S, S + 6000).source(beats()).sink(CallbackSink("s", handler, on_error="isolate"), HB)
    assert soft.execute(spark).status is Status.COMPLETE
    assert open(log).read().split() == ["START", "DATA", "DATA", "DATA", "STOP", "END"]


def test_broken_sources_keep_what_came_before(spark, tmp_path):
    path = jsonl(tmp_path / "c.jsonl", [{"beatKey": "BEAT", "beatTime": S + 1000}, "this is not valid json", {"beatKey": "BEAT", "beatTime": S + 2000}])
    plan = Run(S, S + 9000).source(JsonlSource("r", {HB: None}, path)).plan(spark)
    assert ordered(plan.events) == [("hb", 1000)] and "r" in plan.failed_sources
    for lost in ({"beatKey": "BEAT", "beatTime": None}, {"beatKey": "BEAT"}, {"beatKey": "BEAT", "beatTime": "12x"}):
        path = jsonl(tmp_path / "d.jsonl", [{"beatKey": "BEAT", "beatTime": S + 1000}, lost, {"beatKey": "BEAT", "beatTime": S + 2000}])
        assert ordered(Run(S, S + 9000).source(JsonlSource("r", {HB: None}, path)).plan(spark).events) == [("hb", 1000)]

    def produce():
        yield "one", {"msgKey": "A", "msgTime": S + 1, "text": "x"}
        yield "nowhere", {"msgKey": "A", "msgTime": S + 2, "text": "x"}

    plan = Run(S, S + 9000).source(IterableSource("p", {ONE: None}, produce)).plan(spark)
    assert ordered(plan.events) == [("one", 1)] and "nowhere" in plan.failed_sources["p"]


def test_reader_order_of_checks(spark, tmp_path):
    line = lambda k, t: {"msgKey": k, "msgTime": S + t, "text": "x"}
    path = jsonl(tmp_path / "r.jsonl", [line("B", 99_000), line("A", -5), "", line("A", 1), line("A", 99_000), line("A", 2)])
    assert ordered(Run(S, S + 9000).source(JsonlSource("r", {ONE: ["A"]}, path)).plan(spark).events) == [("one", 1)]
    tagged = jsonl(tmp_path / "t.jsonl", [{"typeId": "TextMessage", "payload": line("A", 3)}, {"typeId": "HeartBeat", "payload": {"beatKey": "k", "beatTime": S + 4}}, {"typeId": "Nope", "payload": {}}])
    plan = Run(S, S + 9000).source(JsonlSource("r", {ONE: None, HB: None}, tagged, tagged=True)).plan(spark)
    assert ordered(plan.events) == [("one", 3), ("hb", 4)] and plan.failed_sources


def test_routes():
    a, b = FrameSink("a"), FrameSink("b")
    run = Run(0, 1).sink(a, ONE, ["A"]).sink(a, ONE, ["A", "B"])
    for keys in (["B"], None):
        with pytest.raises(RouteConflict):
            run.sink(b, ONE, keys)
    assert run.subscribers.find(ONE, "B") is a
    run.unregister(b, ONE, ["A"])
    assert run.subscribers.find(ONE, "A") is a
    run.unregister(a, ONE, ["A"])
    assert run.subscribers.find(ONE, "A") is None
    run.source(messages("m", ONE, [1]))
    with pytest.raises(RouteConflict):
        run.source(messages("n", ONE, [1]))


def test_builds_that_are_refused(spark):
    with pytest.raises(ValueError, match="fed by"):
        Run(S, S + 1).source(messages("m", ONE, [1])).actor(ColumnarActor("x", {}, {ONE: None})).plan(spark)
    other = Topic("one", HEART_BEAT)
    assert other != ONE
    with pytest.raises(ValueError, match="two payload types"):
        Run(S, S + 1).source(messages("m", ONE, [1])).sink(FrameSink("s"), other).plan(spark)
    with pytest.raises(ValueError, match="name"):
        Topic("", HEART_BEAT)
    with pytest.raises(ValueError, match="period"):
        HeartbeatSource("h", {HB: None}, "k", 0)
    with pytest.raises(ValueError, match="no field"):
        PayloadType("x", HEART_BEAT.schema, "a", "b")
    with pytest.raises(ValueError, match="another"):
        register(PayloadType("HeartBeat", HEART_BEAT.schema, "beatTime", "beatTime"))
    with pytest.raises(Unbound):
        Component().publish("x", {})
    with pytest.raises(ValueError, match="declare"):
        Run(S, S + 9).source(messages("m", ONE, [1])).actor(ColumnarActor("x", {ONE: None}, {}, fn=lambda n, e: {"echo": e})).plan(spark)


def test_mode():
    assert mode_of(1000, 1001) is Mode.COMPRESSED_TIME and mode_of(1000, 1000) is Mode.REAL_TIME


def test_codec(spark):
    vec = {"key": "k", "time": 1, "values": [Decimal("1.20"), Decimal("0.80")], "valueIds": ["macd", "signal"]}
    cases = [
        (VECTOR_VALUE, vec, True), (VECTOR_VALUE, {**vec, "valueIds": None}, True), (VECTOR_VALUE, {**vec, "valueIds": ["x"]}, False), (VECTOR_VALUE, {**vec, "values": None}, False),
        (HEART_BEAT, {"beatKey": "b", "beatTime": 5}, True), (HEART_BEAT, {"beatKey": "b", "beatTime": None}, False), (TEXT_MESSAGE, {"msgKey": "a", "msgTime": 1, "text": "t"}, True),
    ]
    for kind, payload, fine in cases:
        df = spark.createDataFrame([(tuple(payload.get(n) for n in kind.schema.fieldNames()),)], "p " + kind.schema.simpleString()).select(codec.to_tagged(F.col("p"), kind).alias("j"), "p")
        back = df.select(codec.parse_tagged(F.col("j"), kind).alias("q"), "p", "j").first()
        assert (back.q == back.p) is fine and (back.q is None) is not fine
        assert ("valueIds" in back.j) is (payload.get("valueIds") is not None)
    bars = ['{"symb":"A","timestamp":1,"op":"10.20","hi":11,"lo":10.1,"cl":10.5,"extra":[1]}', '{"symb":"A","timestamp":1}', "[]", "x", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in bars], "j string").select(codec.parse(F.col("j"), CDF_BAR)).collect()]
    assert (got[0].op, got[0].hi, got[0].vwap) == (Decimal("10.2"), Decimal(11), None) and got[1:] == [None] * 4


class Counter(Component):
    def __init__(self):
        self.n = 0

    def on_startup(self, start_ms):
        self.publish("echo", {"msgKey": "start", "msgTime": start_ms, "text": "start"})

    def on_event(self, topic, payload):
        self.n += 1

    def on_shutdown(self, last_ms):
        self.publish("echo", {"msgKey": "stop", "msgTime": last_ms, "text": str(self.n)})


def test_row_actor_life(spark):
    run = Run(S, S + 9000).source(messages("m", ONE, [1000, 2000, 3000])).actor(RowActor("c", {ONE: None}, {ECHO: None}, make=Counter))
    got = run.plan(spark).events.where("topic = 'echo'").sort("ord").collect()
    # What is published at shutdown comes behind the last event: it is noted, and heard by nobody.
    assert [(r.key, r.t - S, json.loads(r.json)["text"]) for r in got] == [("start", 0, "start")]
    late = lambda plan: [(r.kind, json.loads(r.message.split(": ", 1)[1])["msgTime"] - S) for r in plan.errors.collect()]
    assert late(run.plan(spark)) == [("late", 3000)]
    idle = Run(S, S + 9000).source(messages("m", ONE, [])).actor(RowActor("c", {ONE: None}, {ECHO: None}, make=Counter)).plan(spark)
    assert [(r.key, r.t - S) for r in idle.events.sort("ord").collect()] == [("start", 0)] and late(idle) == [("late", 0)]


class Logs(Component):
    """Writes its life to a file, one line per call."""

    def __init__(self, path, name, fails=""):
        self.path, self.name, self.fails = path, name, fails

    def note(self, what):
        with open(self.path, "a") as f:
            f.write(f"{self.name} {what}\n")
        if what.split()[0] == self.fails:
            raise RuntimeError("fails")

    def on_startup(self, start_ms):
        self.note(f"start {start_ms - S}")

    def on_event(self, topic, payload):
        self.note("event")

    def on_shutdown(self, last_ms):
        self.note(f"stop {last_ms - S}")

    def on_abort(self):
        self.note("abort")


class Bare:
    """No base, no life-cycle calls, no publishing."""

    __slots__ = ()

    def on_event(self, topic, payload):
        assert payload["text"]


def test_life_cycle_times_and_order(spark, tmp_path):
    log = str(tmp_path / "log")
    logs = lambda name, fails="": lambda: Logs(log, name, fails)
    run = Run(S, S + 9000).source(messages("m", ONE, [1000])).source(messages("n", TWO, [5000]))
    # "high" goes first in dispatch, but starts and ends as registered; the shutdown has the run's last time, an echo's.
    run.actor(RowActor("low", {ONE: None}, {}, make=logs("low"))).actor(RowActor("high", {ONE: None}, {}, True, make=logs("high"))).actor(echo("e", TWO, ECHO, delay_ms=2000)).actor(RowActor("bare", {ONE: None}, make=Bare))
    result = run.execute(spark)
    lines = open(log).read().split("\n")[:-1]
    assert run.status is Status.COMPLETE and result.errors.count() == 0 and result.last_time == S + 7000
    assert sorted(lines[:4]) == ["high event", "high start 0", "low event", "low start 0"] and sorted(lines[4:]) == ["high stop 7000", "low stop 7000"]
    open(log, "w").close()
    # Members of a cycle share a task: here the order of calls shows.
    pair = Run(S, S + 9000).source(messages("m", ONE, [1000]))
    pair.actor(RowActor("low", {ONE: None, ECHO: None}, {ECHO: None}, make=logs("low"))).actor(RowActor("high", {ONE: None, ECHO: None}, {ECHO: None}, True, make=logs("high"))).plan(spark)
    assert open(log).read().split("\n")[:-1] == ["low start 0", "high start 0", "high event", "low event", "low stop 1000", "high stop 1000"]


def test_failed_start_end_and_sink_abort_once(spark, tmp_path):
    log = str(tmp_path / "log")
    for fails, want in (("start", ["a start 0", "a abort"]), ("stop", ["a start 0", "a event", "a stop 1000", "a abort", "a abort"])):
        open(log, "w").close()
        run = Run(S, S + 9000).source(messages("m", ONE, [1000])).actor(RowActor("a", {ONE: None}, make=lambda fails=fails: Logs(log, "a", fails)))
        with pytest.raises(RunFailed, match="fails"):
            run.execute(spark)
        assert run.status is Status.STOPPED and open(log).read().split("\n")[:-1] == want
    open(log, "w").close()

    def handler():
        def handle(kind, topic, text, t):
            if kind == "DATA":
                raise RuntimeError("sink")

        return handle

    run = Run(S, S + 9000).source(messages("m", ONE, [1000])).actor(RowActor("a", {ONE: None}, make=lambda: Logs(log, "a"))).sink(CallbackSink("s", handler), ONE)
    with pytest.raises(RunFailed):
        run.execute(spark)
    assert run.status is Status.STOPPED and open(log).read().split("\n")[:-1] == ["a start 0", "a event", "a abort"]


class Sloppy(Component):
    def on_event(self, topic, payload):
        n = payload["msgTime"] - S
        self.publish("echo", {1000: {"msgKey": "A", "msgTime": S + n}, 2000: {"msgKey": None, "msgTime": S + n, "text": "x"}, 3000: {"msgKey": "A", "msgTime": S + n, "text": "fine"}}[n])


def test_invalid_publishes_become_error_rows(spark):
    plan = Run(S, S + 9000).source(messages("m", ONE, [1000, 2000, 3000])).actor(RowActor("s", {ONE: None}, {ECHO: None}, make=Sloppy)).plan(spark)
    assert ordered(plan.events.where("topic = 'echo'")) == [("echo", 3000)]
    assert sorted((r.t - S, r.kind) for r in plan.errors.collect()) == [(1000, "error"), (2000, "error")]

    def fn(name, events):
        payload = F.struct(F.when(F.col("t") == S + 1000, "A").alias("msgKey"), F.col("t").alias("msgTime"), F.lit("x").alias("text"))
        return {"echo": events.select("ord", "t", F.lit(0).cast("bigint").alias("emit"), payload.alias("payload"))}

    plan = Run(S, S + 9000).source(messages("m", ONE, [1000, 2000])).actor(ColumnarActor("c", {ONE: None}, {ECHO: None}, fn=fn)).plan(spark)
    assert ordered(plan.events.where("topic = 'echo'")) == [("echo", 1000)] and [(r.t - S, r.kind) for r in plan.errors.collect()] == [(2000, "error")]


class Tally(Component):
    """Counts what it hears and passes the count on, to its partner's topic."""

    def __init__(self, out, key=None):
        self.out, self.key, self.n = out, key, 0

    def on_event(self, topic, payload):
        self.n += 1
        if topic == "one":
            self.publish(self.out, {"msgKey": self.key or payload["msgKey"], "msgTime": payload["msgTime"], "text": f"{payload['msgKey']}{self.n}"})


def test_components_by_key_in_a_cycle(spark):
    three = Topic("three", TEXT_MESSAGE)
    source = IterableSource("m", {ONE: None}, lambda: [("one", {"msgKey": k, "msgTime": S + i, "text": "x"}) for i, k in enumerate("ABA")])

    def run(by_key=(True, True), key=None):
        pair = Run(S, S + 9000).source(source).actor(RowActor("p", {ONE: None, three: None}, {ECHO: None}, make=lambda: Tally("echo", key), by_key=by_key[0]))
        return pair.actor(RowActor("q", {ECHO: None}, {three: None}, make=lambda: Tally("three"), by_key=by_key[1])).plan(spark)

    texts = lambda plan: [json.loads(r.json)["text"] for r in plan.events.where("topic = 'echo'").sort("ord").collect()]
    assert texts(run()) == ["A1", "B1", "A2"] and texts(run((False, False))) == ["A1", "B2", "A3"]
    with pytest.raises(ValueError, match="all have components by key"):
        run((True, False))
    # In a cycle by key a component may publish for its own key only.
    other = run(key="A")
    assert texts(other) == ["A1", "A2"] and [r.message.split(": ")[0] for r in other.errors.collect()] == ["ValueError"]


def test_window_that_is_not_over_is_live(spark):
    with pytest.raises(NotOver):
        Run(S, 4_102_444_800_000).source(messages("m", ONE, [1])).execute(spark)
    assert Run(S, S + 9).mode is Mode.COMPRESSED_TIME


def test_broken_line_behind_the_readers_stop_is_never_met(spark, tmp_path):
    lines = [{"msgKey": "A", "msgTime": S + t, "text": "x"} for t in (10, 20, 999, 30)] + ["broken"]
    plan = Run(S, S + 100).source(JsonlSource("r", {ONE: None}, jsonl(tmp_path / "f.jsonl", lines))).plan(spark)
    assert ordered(plan.events) == [("one", 10), ("one", 20)] and plan.failed_sources == {}


def test_isolating_sink_notes_what_it_passes_over(spark):
    def handler():
        def handle(kind, topic, text, t):
            if t == S + 3500:
                raise RuntimeError("sink")

        return handle

    run = Run(S, S + 6000).source(HeartbeatSource("b", {HB: None}, "BEAT", 2000, S + 1500)).sink(CallbackSink("s", handler, on_error="isolate"), HB)
    assert [(r.actor, r.t - S, r.message) for r in run.execute(spark).errors.collect()] == [("s", 3500, "RuntimeError: sink")]


def test_guard_over_sparse_places(spark):
    rng = random.Random(2)
    rows = [(n, rng.randint(0, 500) + i) for i, n in enumerate(sorted({rng.randrange(-(2**62), 2**62) for _ in range(400)}))]
    top, want = None, []
    for n, t in rows:
        if top is None or t >= top:
            want.append(n)
            top = t
    assert sorted(r.seq for r in monotonic_guard(spark.createDataFrame(rows, "seq bigint, t bigint"), "seq").collect()) == want


def test_frames_and_other_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "A", S + 5, "x"), (2, "A", None, "x"), (3, None, S + 6, "x"), (4, "A", S + 7, None)], "n bigint, k string, t bigint, payload string")
    seen = []
    run = Run(S, S + 9000).source(FrameSource("f", {ONE: None}, df, {"msgKey": "k", "msgTime": "t", "text": "payload"}, ["n"])).sink(PrintSink("p", show=seen.append), ONE)
    run.source(messages("b", TWO, [6])).sink(ParquetSink("q", str(tmp_path / "q")), TWO).execute(spark)
    assert [x.split(" <- ")[0] for x in seen] == ["one", "one"] and spark.read.parquet(str(tmp_path / "q")).count() == 1


def test_reports():
    got = []
    set_default_reporter(CallbackReporter(lambda *a: got.append(a), ReportLevel.WARNING))
    handle = ComponentReporter("c")
    handle.info(lambda: 1 / 0)
    handle.warn("w")
    handle.fatal(lambda: "f")
    assert [(a[1], a[2], a[3]) for a in got] == [("c", "w", ReportLevel.WARNING), ("c", "f", ReportLevel.FATAL)]
    assert ReportLevel.FATAL.meets(ReportLevel.SEVERE) and not ReportLevel.INFO.meets(ReportLevel.WARNING)


def test_log_files_roll_by_size_and_total(tmp_path):
    path = str(tmp_path / "run.log")
    configure_logging(ReportLevel.INFO, path, most_bytes=400, total_bytes=1300)
    handle = ComponentReporter("part", LoggingReporter())
    for i in range(60):
        handle.info(lambda i=i: f"line {i}")
    handle.large_info("unseen")
    files = sorted(tmp_path.iterdir())
    assert 3 <= len(files) <= 5 and all(f.stat().st_size <= 400 for f in files) and sum(f.stat().st_size for f in files) <= 1700
    last = open(path).read().strip().split("\n")[-1]
    assert last.endswith("[INFO] {part} : line 59")
    configure_logging()


def queue_model(sources, actors, start, end):
    """An event loop: the head of each source competes; derived events queue up with the numbers of their arrival."""
    heads, derived, out, number = [], [], [], 0
    for i, (rank, times) in enumerate(sources):
        kept, top = [], None
        for n, t in enumerate(times):
            if start <= t <= end and (top is None or t >= top):
                kept.append((t, 0, rank, i, n))
                top = t
        heads.append(kept)
    while any(heads) or derived:
        best = min([h[0] for h in heads if h] + ([derived[0][0]] if derived else []))
        if best[1] == 0:
            heads[best[3]].pop(0)
            topic = f"s{best[3]}"
        else:
            topic = heapq.heappop(derived)[1]
        out.append((topic, best[0]))
        for k, (listens, delay) in enumerate(actors):
            if topic in listens and best[0] + delay <= end:
                number += 1
                heapq.heappush(derived, ((best[0] + delay, 1, number), f"d{k}"))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_random_topologies_match_a_queue(spark, seed):
    rng = random.Random(seed)
    sources = [(rng.randint(0, 1), [rng.randint(0, 12) for _ in range(rng.randint(0, 9))]) for _ in range(rng.randint(1, 4))]
    names = [f"s{i}" for i in range(len(sources))]
    actors = []
    for k in range(rng.randint(0, 3)):
        actors.append((set(rng.sample(names, rng.randint(1, len(names)))), rng.randint(0, 3)))
        names.append(f"d{k}")
    topics = {n: Topic(n, TEXT_MESSAGE) for n in names}
    run = Run(2, 10)
    for i, (rank, times) in enumerate(sources):
        make = lambda i=i, times=times: [(f"s{i}", {"msgKey": "A", "msgTime": t, "text": "x"}) for t in times]
        run.source(IterableSource(f"s{i}", {topics[f"s{i}"]: None}, make), high_priority=rank == 0)
    for k, (listens, delay) in enumerate(actors):
        parts = {topics[n]: None for n in sorted(listens)}

        def fn(name, events, k=k, delay=delay):
            payload = F.struct(F.lit("A").alias("msgKey"), (F.col("t") + delay).alias("msgTime"), F.lit("x").alias("text"))
            return {f"d{k}": events.select("ord", "t", F.lit(0).cast("bigint").alias("emit"), payload.alias("payload"))}

        run.actor(ColumnarActor(f"a{k}", parts, {topics[f"d{k}"]: None}, fn=fn))
    got = [(r.topic, r.t) for r in run.plan(spark).events.sort("ord").collect()]
    assert got == queue_model(sources, actors, 2, 10)
