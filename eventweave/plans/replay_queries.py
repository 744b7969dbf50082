"""Queries of the replay engine over the whole test tables, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventweave.functions import codec
from eventweave.operators.actors import ColumnarActor, Component, RowActor, echo
from eventweave.operators.merge import in_window, monotonic_guard, source_key, until_stop, with_position
from eventweave.operators.routing import RouteConflict
from eventweave.plans.run import Run
from eventweave.session import scratch_path, table
from eventweave.sources import FrameSource, HeartbeatSource, IterableSource, JsonlSource
from eventweave.sources.sinks import FrameSink, JsonlSink
from eventweave.streaming.live import LiveRun, live_jsonl
from eventweave.topics import CDF_BAR, HEART_BEAT, TEXT_MESSAGE, VECTOR_VALUE, PayloadType, Topic

#: A window inside the month that the events cover: 3 to 24 January 2024.
START, END = 1_704_240_000_000, 1_706_140_800_000
HOUR, ALWAYS = 3_600_000, 4_102_444_800_000
#: The event whose line is broken in `broken_source`.
BROKEN = 700

EVENT = PayloadType(
    "UserEvent",
    T.StructType([T.StructField("event_type", T.StringType()), T.StructField("t", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("value", T.DoubleType())]),
    "event_type", "t", ("event_type", "t", "event_id"),
)
STREAM, BEATS, ECHOES, SECOND = Topic("events", EVENT), Topic("beats", HEART_BEAT), Topic("echoes", TEXT_MESSAGE), Topic("second", TEXT_MESSAGE)


def ms(ts: str) -> Column:
    """Epoch ms of a timestamp without zone, whatever the session's zone."""
    return F.call_function("div", F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})"), F.lit(1000).cast("bigint"))


def _events(spark: SparkSession, sf_dir: str, jitter: bool = False) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value", ms("ts").alias("t"))
    return df.withColumn("t", F.col("t") - F.col("event_id") % 7 * 600_000) if jitter else df


def _source(spark: SparkSession, sf_dir: str, name: str = "events", keys: list[str] | None = None, **kw: Any) -> FrameSource:
    fields = {c: c for c in ("event_type", "t", "event_id", "user_id", "value")}
    return FrameSource(name, {STREAM: keys}, _events(spark, sf_dir, **kw), fields, ["event_id"])


def _tables(spark: SparkSession, sf_dir: str, high: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.lit("orders").alias("topic"), F.col("o_orderpriority").alias("key"), ms("o_orderdate").alias("t"), F.col("o_orderkey").alias("id"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.lit("lineitem").alias("topic"), F.col("l_returnflag").alias("key"), ms("l_shipdate").alias("t"), F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_suppkey"
    )
    one = orders.select(source_key(F.col("t"), int(high != "orders"), 0, F.col("id"), F.ascii("key")).alias("ord"), "topic", "key", "t", "id")
    two = lines.select(
        source_key(F.col("t"), int(high != "lineitem"), 1, F.col("id"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.ascii("key")).alias("ord"), "topic", "key", "t", "id"
    )
    return with_position(one.unionByName(two)).select("pos", "topic", "key", "t", "id")


def merge_orders_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables with heavy ties merged into one numbered stream; the first registered leads at equal times."""
    return _tables(spark, sf_dir, "")


def tie_break_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with lineitem of high priority, which turns the ties round."""
    return _tables(spark, sf_dir, "lineitem")


def heartbeat_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and hourly beats in a window, numbered."""
    run = Run(START, END).source(_source(spark, sf_dir)).source(HeartbeatSource("hb", {BEATS: None}, "BEAT", HOUR, START))
    return with_position(run.plan(spark).events.select("ord", "topic", "key", "t")).select("pos", "topic", "key", "t")


def window_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of start <= t <= end."""
    events = Run(START, END).source(_source(spark, sf_dir)).plan(spark).events
    return events.select("key", "t", F.get_json_object("json", "$.event_id").cast("bigint").alias("event_id"))


def key_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that admits three keys and a sink that takes two of them."""
    sink = FrameSink("kept")
    run = Run(START, END).source(_source(spark, sf_dir, keys=["purchase", "signup", "click"])).sink(sink, STREAM, ["purchase", "signup"])
    return run.plan(spark).deliveries.select("key", "t", "target", "target_kind")


def guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events out of order after the window, less those before the latest time seen."""
    kept = monotonic_guard(in_window(_events(spark, sf_dir, jitter=True), START, END), "event_id")
    return kept.select("event_id", "t")


def reader_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader of one key that ends at its first late event: what comes after is lost even if in time."""
    df = _events(spark, sf_dir, jitter=True)
    kept = until_stop(df, "event_id", (F.col("event_type") == "view") & (F.col("t") > END))
    return in_window(kept.where("event_type = 'view'"), START, None).select("event_id", "t")


def fanout_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries to a sink and four actors, one of them of high priority."""
    run = Run(START, END).source(_source(spark, sf_dir)).sink(FrameSink("all"), STREAM)
    for name, keys, high in (("a", None, False), ("b", ["view", "click"], False), ("c", ["click"], True), ("d", ["error"], False)):
        run.actor(ColumnarActor(name, {STREAM: keys}, high_priority=high))
    return run.delivery_log(spark).select("pos", "key", "t", "target", "target_kind", "target_ord")


def echo_same_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, and an echo of the urgent ones at the same tick, after all orders of that tick."""
    return _echoed(spark, sf_dir, 0).select("pos", "topic", "key", "t")


def _echoed(spark: SparkSession, sf_dir: str, delay: int) -> DataFrame:
    kind = PayloadType("OrderEvent", T.StructType([T.StructField("prio", T.StringType()), T.StructField("t", T.LongType()), T.StructField("id", T.LongType())]), "prio", "t")
    topic = Topic("orders", kind)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("prio"), ms("o_orderdate").alias("t"), F.col("o_orderkey").alias("id"))
    # The source's order is that of its times, so that the guard keeps all.
    source = FrameSource("orders", {topic: None}, orders, {"prio": "prio", "t": "t", "id": "id"}, ["t", "id"])
    run = Run(0, ALWAYS).source(source).actor(echo("echo", topic, ECHOES, delay_ms=delay, keys=["1-URGENT"]))
    return with_position(run.plan(spark).events.select("ord", "topic", "key", "t"))


def delayed_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Echoes six hours later, those within the window only, also after the last source event."""
    run = Run(START, END).source(_source(spark, sf_dir)).actor(echo("echo", STREAM, ECHOES, delay_ms=6 * HOUR))
    return with_position(run.plan(spark).events.select("ord", "topic", "key", "t")).select("pos", "topic", "key", "t")


def _shift(name: str, events: DataFrame) -> dict[str, DataFrame]:
    when = F.col("t") + (F.col("payload.event_id") % 3 - 1) * 500
    payload = F.struct(F.col("key").alias("msgKey"), when.alias("msgTime"), F.col("payload.event_id").cast("string").alias("text"))
    return {"echoes": events.select("ord", "t", F.lit(0).cast("bigint").alias("emit"), payload.alias("payload"))}


def causality_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishes before, at and after the trigger's time: the first are rejected. A row each, with the place in the stream of those published, -1 for the others."""
    plan = Run(0, ALWAYS).source(_source(spark, sf_dir)).actor(ColumnarActor("shift", {STREAM: None}, {ECHOES: None}, fn=_shift)).plan(spark)
    kept = with_position(plan.events.select("ord", "topic", "json")).where("topic = 'echoes'").select("pos", F.col("json").alias("message"), F.lit("published").alias("outcome"))
    lost = plan.errors.select(F.lit(-1).cast("bigint").alias("pos"), "message", F.col("kind").alias("outcome"))
    field = lambda n: F.get_json_object("message", f"$.{n}")
    return kept.unionByName(lost).select("pos", "outcome", field("msgKey").alias("key"), field("msgTime").cast("bigint").alias("t"), field("text").cast("bigint").alias("event_id"))


def two_hop_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An echo at the same tick and a later echo of the echo."""
    run = Run(START, END).source(_source(spark, sf_dir)).actor(echo("one", STREAM, ECHOES, keys=["error"])).actor(echo("two", ECHOES, SECOND, delay_ms=1000))
    return with_position(run.plan(spark).events.select("ord", "topic", "key", "t", "gen")).select("pos", "topic", "key", "t", "gen")


def printer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An actor's running count of its deliveries per key."""
    run = Run(START, END).source(_source(spark, sf_dir)).actor(ColumnarActor("printer", {STREAM: None}))
    return with_position(run.plan(spark).deliveries.select("ord", "target", "key", "t"), by=["target", "key"], out="seen").select("target", "key", "t", "seen")


def unrouted_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without a target take a position but are delivered to nobody."""
    run = Run(START, END).source(_source(spark, sf_dir)).sink(FrameSink("purchases"), STREAM, ["purchase"])
    return run.delivery_log(spark).select("pos", "key", "t", "target")


def bar_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as price bars: to JSON and back, decimals exact."""
    d = lambda c: F.col(c).cast("decimal(18,4)")
    line = table(spark, sf_dir, "lineitem")
    price = {"op": d("l_extendedprice"), "hi": (d("l_extendedprice") + d("l_tax")), "lo": (d("l_extendedprice") - d("l_discount")), "cl": d("l_tax"), "vwap": F.when(F.col("l_linenumber") > 2, d("l_discount"))}
    kinds = {f.name: f.dataType for f in CDF_BAR.schema.fields}
    values = {"symb": F.col("l_returnflag"), "timestamp": ms("l_shipdate"), **price, "vlm": F.col("l_quantity"), "datetime": F.col("l_shipdate"), "date": F.col("l_shipdate"), "count": F.col("l_linenumber")}
    bar = F.struct(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])
    back = line.select("l_orderkey", codec.parse(codec.to_json(bar), CDF_BAR).alias("b"))
    return back.select(
        "l_orderkey", F.col("b.symb").alias("symb"), F.col("b.timestamp").alias("t"), *[F.coalesce(f"b.{c}", F.lit(-1)).cast("decimal(18,4)").alias(c) for c in ("op", "hi", "lo", "cl", "vwap")],
        F.col("b.vlm").alias("vlm"), ms("cast(b.datetime as timestamp_ntz)").alias("at"), F.date_format("b.date", "yyyy-MM-dd").alias("day"), F.col("b.count").alias("n"),
    )


def vector_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as vectors of decimals through a run; one of each seven has a label too few and is rejected. A row per value."""
    vec = table(spark, sf_dir, "embeddings")
    values = F.transform("embedding", lambda x: x.cast("decimal(38,18)"))
    labels = F.transform(F.sequence(F.lit(1), F.size("embedding") - F.when(F.col("vec_id") % 7 == 0, 1).otherwise(0)), lambda i: i.cast("string"))
    made = F.struct(F.col("label").cast("string").alias("key"), F.col("vec_id").alias("time"), values.alias("values"), labels.alias("valueIds"))
    ok = vec.select("vec_id", made.alias("v")).where(codec.valid(F.col("v"), VECTOR_VALUE)).select("vec_id", "v.*")
    topic = Topic("vectors", VECTOR_VALUE)
    source = FrameSource("vectors", {topic: None}, ok, {c: c for c in ("key", "time", "values", "valueIds")}, ["vec_id"])
    got = Run(0, ALWAYS).source(source).plan(spark).events.select(codec.parse(F.col("json"), VECTOR_VALUE).alias("v"))
    each = got.select(F.col("v.time").alias("vec_id"), F.col("v.key").alias("key"), F.inline(F.arrays_zip(F.col("v.valueIds").alias("label"), F.col("v.values").alias("value"))))
    return each.select("vec_id", "key", F.col("label").cast("bigint").alias("place"), F.col("value").cast("decimal(18,6)").alias("value"))


def tagged_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and beats through tagged JSON; broken ones (null fields) don't come back."""
    m = table(spark, sf_dir, "messages_two").select(codec.to_tagged(F.struct("msgKey", "msgTime", "text"), TEXT_MESSAGE).alias("j"))
    h = table(spark, sf_dir, "heart_beats").select(codec.to_tagged(F.struct("beatKey", "beatTime"), HEART_BEAT).alias("j"))
    both = m.unionByName(h).where(codec.known_type(F.col("j")))
    back = both.select(codec.parse_tagged(F.col("j"), TEXT_MESSAGE).alias("m"), codec.parse_tagged(F.col("j"), HEART_BEAT).alias("h")).where("m is not null or h is not null")
    return back.select(F.coalesce("m.msgKey", "h.beatKey").alias("key"), F.coalesce("m.msgTime", "h.beatTime").alias("t"), F.col("m.text").alias("text"))


def _arriving(spark: SparkSession, sf_dir: str, jitter: bool = False) -> DataFrame:
    """All events as they arrive, in three files one after another: a stream."""
    folder = scratch_path(spark, "arriving")
    events = _events(spark, sf_dir, jitter)
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    step = ((high or 0) - (low or 0)) // 3 + 1
    for i in range(3):
        third = events.where((F.col("event_id") >= F.lit((low or 0) + i * step)) & (F.col("event_id") < F.lit((low or 0) + (i + 1) * step)))
        third.sort("event_id").coalesce(1).select(F.to_json(F.struct("event_type", "t", "event_id", "user_id", "value"))).write.text(f"{folder}/part={i}")
    return live_jsonl(spark, STREAM, f"{folder}/*")


def _live(spark: SparkSession, sf_dir: str, run: Run, jitter: bool = False) -> LiveRun:
    live = LiveRun(run, scratch_path(spark, "live"))
    live.start(_arriving(spark, sf_dir, jitter), available_now=True)
    live.wait()
    return live


def live_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live run: in order of arrival, everything ends at the first event past the end."""
    live = _live(spark, sf_dir, Run(START, END).sink(FrameSink("all"), STREAM), jitter=True)
    return live.deliveries(spark).select("pos", F.get_json_object("json", "$.event_id").cast("bigint").alias("event_id"), "key", "t", "target")


def live_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live run with an echo and an echo of the echo, the latter registered first; what was published by its own triggers' order."""
    run = Run(START, END).actor(echo("two", ECHOES, SECOND, delay_ms=1000)).actor(echo("one", STREAM, ECHOES, keys=["error"])).sink(FrameSink("seconds"), SECOND).sink(FrameSink("firsts"), ECHOES)
    got = _live(spark, sf_dir, run).deliveries(spark).where("target_kind = 'sink'").select("pos", "topic", "key", "t")
    return with_position(got, "pos", "place", by=["topic"]).select("topic", "key", "t", "place")


def live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live run in which a row actor's sums per key go on over the batches."""
    run = Run(START, END).actor(RowActor("sums", {STREAM: None}, {ECHOES: None}, make=_Hundredth, by_key=True)).sink(FrameSink("sums-out"), ECHOES)
    got = _live(spark, sf_dir, run, jitter=False).deliveries(spark).where("target = 'sums-out'")
    return got.select("key", "t", F.get_json_object("json", "$.text").cast("bigint").alias("total"))


def live_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live run whose actor publishes before its triggers: each reject is an error row."""
    live = _live(spark, sf_dir, Run(0, ALWAYS).actor(ColumnarActor("shift", {STREAM: None}, {ECHOES: None}, fn=_shift)))
    return live.errors(spark).select("actor", "kind", "t", F.get_json_object("message", "$.text").cast("bigint").alias("event_id"))


class _Picky(Component):
    """Fails on every fifth event it is given, and notes the others."""

    def on_event(self, topic: str, payload: dict[str, Any]) -> None:
        if payload["event_id"] % 5 == 0:
            raise ValueError(payload["event_id"])
        self.publish("echoes", {"msgKey": payload["event_type"], "msgTime": payload["t"], "text": str(payload["event_id"])})


def isolated_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row actor that fails on some events: a row per event, handled or failed."""
    plan = Run(START, END).source(_source(spark, sf_dir)).actor(RowActor("picky", {STREAM: None}, {ECHOES: None}, make=_Picky, by_key=True)).plan(spark)
    ok = plan.events.where("topic = 'echoes'").select(F.get_json_object("json", "$.text").cast("bigint").alias("event_id"), "t", F.lit("handled").alias("outcome"))
    bad = plan.errors.select(F.regexp_extract("message", r"^ValueError: (\d+)$", 1).cast("bigint").alias("event_id"), "t", F.when(F.col("kind") == "error", "failed").alias("outcome"))
    return ok.unionByName(bad)


class _Ledger(_Picky):
    """Counts its events per key, and says how many at the end."""

    def __init__(self) -> None:
        self.n = 0

    def on_startup(self, start_ms: int) -> None:
        self.begun = start_ms

    def on_event(self, topic: str, payload: dict[str, Any]) -> None:
        self.n, self.key = self.n + 1, payload["event_type"]

    def on_shutdown(self, last_ms: int) -> None:
        self.publish("echoes", {"msgKey": self.key, "msgTime": last_ms, "text": f"{self.begun}:{self.n}"})


def life_cycle_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components per key start with the run's start and end with the time of its last event, which an echo of another topic gives."""
    run = Run(START, END).source(_source(spark, sf_dir)).actor(RowActor("ledger", {STREAM: None}, {SECOND: None, ECHOES: None}, make=_Ledger, by_key=True))
    beats = HeartbeatSource("hb", {BEATS: None}, "BEAT", HOUR, END - HOUR)
    late = run.source(beats).plan(spark).errors.where("kind = 'late'").select(F.regexp_extract("message", r"\{.*", 0).alias("m"))
    field = lambda n: F.get_json_object("m", f"$.{n}")
    return late.select(field("msgKey").alias("key"), field("msgTime").cast("bigint").alias("last"), F.split(field("text"), ":")[0].cast("bigint").alias("begun"), F.split(field("text"), ":")[1].cast("bigint").alias("n"))


class _Hundredth(Component):
    """Keeps a running sum per key and publishes it with every hundredth event."""

    def __init__(self) -> None:
        self.n = self.total = 0

    def on_event(self, topic: str, payload: dict[str, Any]) -> None:
        self.n += 1
        self.total += payload["user_id"]
        if self.n % 100 == 0:
            self.publish("echoes", {"msgKey": payload["event_type"], "msgTime": payload["t"], "text": str(self.total)})


def row_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of a row actor kept per key over ordered events."""
    run = Run(START, END).source(_source(spark, sf_dir)).actor(RowActor("sums", {STREAM: None}, {ECHOES: None}, make=_Hundredth, by_key=True))
    return run.plan(spark).events.where("topic = 'echoes'").select("key", "t", F.get_json_object("json", "$.text").cast("bigint").alias("total"))


class _Countdown(Component):
    """Answers each event with a chain of its own events, one less each time."""

    def on_event(self, topic: str, payload: dict[str, Any]) -> None:
        left = payload["event_id"] % 3 if topic == "events" else int(payload["text"]) - 1
        if left > 0:
            self.publish("echoes", {"msgKey": payload.get("event_type", payload.get("msgKey")), "msgTime": payload["t"] if topic == "events" else payload["msgTime"] + 10, "text": str(left)})


def feedback_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An actor that hears its own topic: what it published, by key and remaining steps, with its place in the stream."""
    run = Run(START, END).source(_source(spark, sf_dir, keys=["signup"])).actor(RowActor("down", {STREAM: None, ECHOES: None}, {ECHOES: None}, make=_Countdown))
    got = with_position(run.plan(spark).events.select("ord", "topic", "key", "t", "json")).where("topic = 'echoes'")
    return got.select("pos", "key", "t", F.get_json_object("json", "$.text").alias("left"))


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines in dispatch order by a sink and replayed from the files."""
    path = scratch_path(spark, "jsonl")
    Run(START, END).source(_source(spark, sf_dir)).sink(JsonlSink("file", path), STREAM, ["view", "click"]).execute(spark)
    again = Run(START, END - 48 * HOUR).source(JsonlSource("reader", {STREAM: ["view"]}, path)).plan(spark).events
    return again.select("key", "t", F.get_json_object("json", "$.event_id").cast("bigint").alias("event_id"))


def typed_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed messages and beats in one numbered stream, each guarded against backward times."""
    msgs, beats = table(spark, sf_dir, "messages_two"), table(spark, sf_dir, "heart_beats")
    texts = FrameSource("m", {Topic("messages", TEXT_MESSAGE): None}, msgs, {"msgKey": "msgKey", "msgTime": "msgTime", "text": "text"}, ["msg_id"])
    beating = FrameSource("h", {BEATS: None}, beats, {"beatKey": "beatKey", "beatTime": "beatTime"}, ["beat_id"])
    return with_position(Run(0, ALWAYS).source(texts).source(beating).plan(spark).events.select("ord", "topic", "key", "t")).select("pos", "topic", "key", "t")


def echo_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an echo says: the topic and the event's JSON."""
    beats = HeartbeatSource("hb", {BEATS: None}, "BEAT", HOUR, START)
    events = Run(START, END).source(beats).actor(echo("parrot", BEATS, ECHOES)).plan(spark).events.where("topic = 'echoes'")
    return events.select("key", "t", F.get_json_object("json", "$.text").alias("text"))


def route_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinks whose keys overlap, grow and shrink: a second owner is refused, and nobody takes away what isn't theirs."""
    a, b = FrameSink("a"), FrameSink("b")
    run = Run(START, END).source(_source(spark, sf_dir)).sink(a, STREAM, ["view"]).sink(a, STREAM, ["view", "click", "error"])
    try:
        run.sink(b, STREAM, ["purchase", "click"])
    except RouteConflict:
        run.sink(b, STREAM, ["purchase"])
    run.unregister(b, STREAM, ["view"]).unregister(a, STREAM, ["error"])
    return run.plan(spark).deliveries.select("key", "t", "target")


def broken_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with a broken line: what came before it is replayed, and the source counts as failed."""
    path, events = scratch_path(spark, "broken"), _events(spark, sf_dir)
    line = F.when(F.col("event_id") == BROKEN, "{broken").otherwise(F.to_json(F.struct("event_type", "t", "event_id", "user_id", "value")))
    events.sort("event_id").coalesce(1).select(line.alias("value")).write.text(path)
    plan = Run(0, ALWAYS).source(JsonlSource("reader", {STREAM: None}, path)).plan(spark)
    return plan.events.select("key", "t", F.get_json_object("json", "$.event_id").cast("bigint").alias("event_id"), F.lit("reader" in plan.failed_sources).alias("failed"))


def iterable_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a Python generator, up to one on a topic that the source doesn't declare."""

    def produce() -> Iterator[tuple[str, dict[str, Any]]]:
        for i in range(20_000):
            yield "nowhere" if i == 15_000 else "beats", {"beatKey": f"k{i % 3}", "beatTime": START + i}

    events = Run(START, END).source(IterableSource("made", {BEATS: ["k0", "k1"]}, produce)).plan(spark).events
    return with_position(events.select("ord", "key", "t")).select("pos", "key", "t")


def tagged_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and beats in one tagged file, by their ids, through one source of two topics, guarded together."""
    messages = Topic("messages", TEXT_MESSAGE)
    m = table(spark, sf_dir, "messages_two").where("msgKey is not null and msgTime is not null and text is not null")
    h = table(spark, sf_dir, "heart_beats").where("beatKey is not null and beatTime is not null")
    lines = m.select("msg_id", F.lit(0).alias("kind"), codec.to_tagged(F.struct("msgKey", "msgTime", "text"), TEXT_MESSAGE).alias("value"))
    lines = lines.unionByName(h.select(F.col("beat_id").alias("msg_id"), F.lit(1).alias("kind"), codec.to_tagged(F.struct("beatKey", "beatTime"), HEART_BEAT).alias("value")))
    path = scratch_path(spark, "tagged")
    lines.sort("msg_id", "kind").coalesce(1).select("value").write.text(path)
    plan = Run(0, ALWAYS).source(JsonlSource("reader", {messages: None, BEATS: None}, path, tagged=True)).plan(spark)
    return with_position(plan.events.select("ord", "topic", "key", "t")).select("pos", "topic", "key", "t")


QUERIES = {
    f.__name__: f
    for f in (
        merge_orders_lineitem, tie_break_priority, heartbeat_merge, window_replay, key_route, guard, reader_stop, fanout_priority, echo_same_tick, delayed_publish,
        causality_reject, two_hop_chain, printer_count, unrouted_positions, bar_payloads, vector_values, tagged_roundtrip, live_cutoff, live_chain, live_state, live_rejects, isolated_errors, life_cycle_times, row_state,
        feedback_cycle, jsonl_roundtrip, typed_replay, echo_text, route_changes, broken_source, iterable_source, tagged_source,
    )
}
QUERIES["monotonic_guard"] = QUERIES.pop("guard")

_MS = "(epoch_us({0}) // 1000)"
_EV = f"ev AS (SELECT event_id, event_type, user_id, value, {_MS.format('ts')} AS t FROM events)"
_JEV = f"ev AS (SELECT event_id, event_type, {_MS.format('ts')} - event_id % 7 * 600000 AS t FROM events)"
_IN = f"w AS (SELECT * FROM ev WHERE t BETWEEN {START} AND {END})"


def _merge_sql(rank_orders: int, rank_lines: int) -> str:
    return f"""WITH u AS (
        SELECT 'orders' AS topic, o_orderpriority AS key, {_MS.format("o_orderdate")} AS t, o_orderkey AS id, {rank_orders} AS r, 0 AS i, o_orderkey AS s1, ascii(o_orderpriority) AS s2, 0 AS s3, 0 AS s4, 0 AS s5 FROM orders
        UNION ALL SELECT 'lineitem', l_returnflag, {_MS.format("l_shipdate")}, l_orderkey, {rank_lines}, 1, l_orderkey, l_linenumber, l_partkey, l_suppkey, ascii(l_returnflag) FROM lineitem)
        SELECT row_number() OVER (ORDER BY t, r, i, s1, s2, s3, s4, s5) AS pos, topic, key, t, id FROM u"""


ORACLE = {
    "merge_orders_lineitem": _merge_sql(1, 1),
    "tie_break_priority": _merge_sql(1, 0),
    "heartbeat_merge": f"""WITH {_EV}, u AS (SELECT 'events' AS topic, event_type AS key, t, 0 AS i, event_id AS s FROM ev WHERE t BETWEEN {START} AND {END}
        UNION ALL SELECT 'beats', 'BEAT', b, 1, b FROM range({START}, {END} + 1, {HOUR}) r(b)) SELECT row_number() OVER (ORDER BY t, i, s) AS pos, topic, key, t FROM u""",
    "window_replay": f"WITH {_EV}, {_IN} SELECT event_type AS key, t, event_id FROM w",
    "key_route": f"WITH {_EV}, {_IN} SELECT event_type AS key, t, 'kept' AS target, 'sink' AS target_kind FROM w WHERE event_type IN ('purchase', 'signup')",
    "monotonic_guard": f"""WITH {_JEV}, {_IN}, g AS (SELECT *, max(t) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM w)
        SELECT event_id, t FROM g WHERE m IS NULL OR t >= m""",
    "reader_stop": f"""WITH {_JEV} SELECT event_id, t FROM ev WHERE event_type = 'view' AND t >= {START}
        AND event_id < coalesce((SELECT min(event_id) FROM ev WHERE event_type = 'view' AND t > {END}), 9000000000000000)""",
    "fanout_priority": f"""WITH {_EV}, {_IN}, p AS (SELECT *, row_number() OVER (ORDER BY t, event_id) AS pos FROM w),
        s(target, target_kind, target_ord, k) AS (VALUES ('all', 'sink', -1, NULL), ('c', 'actor', 0, 'click'), ('a', 'actor', 1, NULL), ('b', 'actor', 2, 'view'), ('b', 'actor', 2, 'click'), ('d', 'actor', 3, 'error'))
        SELECT pos, event_type AS key, t, target, target_kind, CAST(target_ord AS BIGINT) AS target_ord FROM p JOIN s ON k IS NULL OR k = event_type""",
    "echo_same_tick": f"""WITH o AS (SELECT o_orderpriority AS key, {_MS.format("o_orderdate")} AS t, o_orderkey AS id FROM orders),
        n AS (SELECT *, row_number() OVER (ORDER BY t, id) AS s FROM o),
        u AS (SELECT 'orders' AS topic, key, t, 0 AS f, s FROM n UNION ALL SELECT 'echoes', key, t, 1, s FROM n WHERE key = '1-URGENT')
        SELECT row_number() OVER (ORDER BY t, f, s) AS pos, topic, key, t FROM u""",
    "delayed_publish": f"""WITH {_EV}, {_IN}, u AS (SELECT 'events' AS topic, event_type AS key, t, 0 AS f, event_id AS s FROM w
        UNION ALL SELECT 'echoes', event_type, t + {6 * HOUR}, 1, event_id FROM w WHERE t + {6 * HOUR} <= {END})
        SELECT row_number() OVER (ORDER BY t, f, s) AS pos, topic, key, t FROM u""",
    "causality_reject": f"""WITH {_EV}, u AS (SELECT 0 AS f, t, t AS trig, event_type AS key, event_id FROM ev
        UNION ALL SELECT 1, t + (event_id % 3 - 1) * 500, t, event_type, event_id FROM ev WHERE event_id % 3 <> 0),
        p AS (SELECT *, row_number() OVER (ORDER BY t, f, trig, event_id) AS pos FROM u)
        SELECT pos, 'published' AS outcome, key, t, event_id FROM p WHERE f = 1 UNION ALL SELECT -1, 'reject', event_type, t - 500, event_id FROM ev WHERE event_id % 3 = 0""",
    "two_hop_chain": f"""WITH {_EV}, {_IN}, u AS (SELECT 'events' AS topic, event_type AS key, t, 0 AS f, 0 AS g, event_id AS s FROM w
        UNION ALL SELECT 'echoes', event_type, t, 1, 1, event_id FROM w WHERE event_type = 'error'
        UNION ALL SELECT 'second', event_type, t + 1000, 1, 2, event_id FROM w WHERE event_type = 'error' AND t + 1000 <= {END})
        SELECT row_number() OVER (ORDER BY t, f, CASE WHEN g = 2 THEN t - 1000 ELSE t END, s) AS pos, topic, key, t, CAST(g AS INTEGER) AS gen FROM u""",
    "printer_count": f"WITH {_EV}, {_IN} SELECT 'printer' AS target, event_type AS key, t, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) AS seen FROM w",
    "unrouted_positions": f"""WITH {_EV}, {_IN}, p AS (SELECT *, row_number() OVER (ORDER BY t, event_id) AS pos FROM w) SELECT pos, event_type AS key, t, 'purchases' AS target FROM p WHERE event_type = 'purchase'""",
    "bar_payloads": f"""SELECT l_orderkey, l_returnflag AS symb, {_MS.format("l_shipdate")} AS t, CAST(l_extendedprice AS DECIMAL(18,4)) AS op,
        CAST(CAST(l_extendedprice AS DECIMAL(18,4)) + CAST(l_tax AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS hi, CAST(CAST(l_extendedprice AS DECIMAL(18,4)) - CAST(l_discount AS DECIMAL(18,4)) AS DECIMAL(18,4)) AS lo,
        CAST(l_tax AS DECIMAL(18,4)) AS cl, CAST(CASE WHEN l_linenumber > 2 THEN CAST(l_discount AS DECIMAL(18,4)) ELSE -1 END AS DECIMAL(18,4)) AS vwap,
        CAST(l_quantity AS BIGINT) AS vlm, {_MS.format("l_shipdate")} AS at, strftime(l_shipdate, '%Y-%m-%d') AS day, CAST(l_linenumber AS INTEGER) AS n FROM lineitem""",
    "vector_values": """SELECT vec_id, CAST(label AS VARCHAR) AS key, place, CAST(embedding[place] AS DECIMAL(18,6)) AS value
        FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS place FROM embeddings WHERE vec_id % 7 <> 0)""",
    "tagged_roundtrip": """SELECT msgKey AS key, msgTime AS t, text FROM messages_two WHERE msgKey IS NOT NULL AND msgTime IS NOT NULL AND text IS NOT NULL
        UNION ALL SELECT beatKey, beatTime, NULL FROM heart_beats WHERE beatKey IS NOT NULL AND beatTime IS NOT NULL""",
    "live_cutoff": f"""WITH {_JEV} SELECT row_number() OVER (ORDER BY event_id) AS pos, event_id, event_type AS key, t, 'all' AS target FROM ev
        WHERE t >= {START} AND event_id < coalesce((SELECT min(event_id) FROM ev WHERE t > {END}), 9000000000000000)""",
    "live_chain": f"""WITH {_EV}, w AS (SELECT * FROM ev WHERE event_type = 'error' AND t >= {START} AND event_id < coalesce((SELECT min(event_id) FROM ev WHERE t > {END}), 9000000000000000))
        SELECT 'echoes' AS topic, event_type AS key, t, row_number() OVER (ORDER BY event_id) AS place FROM w
        UNION ALL SELECT 'second', event_type, t + 1000, row_number() OVER (ORDER BY event_id) FROM w WHERE t + 1000 <= {END}""",
    "live_state": f"""WITH {_EV}, w AS (SELECT * FROM ev WHERE t >= {START} AND event_id < coalesce((SELECT min(event_id) FROM ev WHERE t > {END}), 9000000000000000)),
        r AS (SELECT event_type AS key, t, row_number() OVER o AS n, CAST(sum(user_id) OVER o AS BIGINT) AS total FROM w WINDOW o AS (PARTITION BY event_type ORDER BY event_id))
        SELECT key, t, total FROM r WHERE n % 100 = 0""",
    "live_rejects": f"WITH {_EV} SELECT 'shift' AS actor, 'reject' AS kind, t, event_id FROM ev WHERE event_id % 3 = 0",
    "life_cycle_times": f"WITH {_EV}, {_IN} SELECT event_type AS key, greatest((SELECT max(t) FROM w), {END}) AS last, CAST({START} AS BIGINT) AS begun, count(*) AS n FROM w GROUP BY 1",
    "isolated_errors": f"WITH {_EV}, {_IN} SELECT event_id, t, CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'handled' END AS outcome FROM w",
    "row_state": f"""WITH {_EV}, {_IN}, r AS (SELECT event_type AS key, t, row_number() OVER o AS n, CAST(sum(user_id) OVER o AS BIGINT) AS total FROM w WINDOW o AS (PARTITION BY event_type ORDER BY t, event_id))
        SELECT key, t, total FROM r WHERE n % 100 = 0""",
    "feedback_cycle": f"""WITH {_EV}, {_IN}, c AS (SELECT event_type AS key, t, event_id, event_id % 3 AS k FROM w WHERE event_type = 'signup'),
        u AS (SELECT 0 AS f, key, t, t AS trig, event_id, 0 AS left_ FROM c UNION ALL SELECT 1, key, t, t, event_id, k FROM c WHERE k > 0
        UNION ALL SELECT 1, key, t + 10, t, event_id, 1 FROM c WHERE k = 2 AND t + 10 <= {END}),
        p AS (SELECT *, row_number() OVER (ORDER BY t, f, trig, event_id) AS pos FROM u) SELECT pos, key, t, CAST(left_ AS VARCHAR) AS "left" FROM p WHERE f = 1""",
    "jsonl_roundtrip": f"WITH {_EV}, {_IN} SELECT event_type AS key, t, event_id FROM w WHERE event_type = 'view' AND t <= {END - 48 * HOUR}",
    "typed_replay": """WITH g AS (SELECT 'messages' AS topic, 0 AS i, msg_id AS id, msgKey AS key, msgTime AS t, max(msgTime) OVER (ORDER BY msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM messages_two WHERE msgKey IS NOT NULL AND msgTime IS NOT NULL
        UNION ALL SELECT 'beats', 1, beat_id, beatKey, beatTime, max(beatTime) OVER (ORDER BY beat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) FROM heart_beats WHERE beatKey IS NOT NULL AND beatTime IS NOT NULL)
        SELECT row_number() OVER (ORDER BY t, i, id) AS pos, topic, key, t FROM g WHERE m IS NULL OR t >= m""",
    "echo_text": f"""SELECT 'BEAT' AS key, b AS t, 'beats :: {{"beatKey":"BEAT","beatTime":' || b || '}}' AS text FROM range({START}, {END} + 1, {HOUR}) r(b)""",
    "route_changes": f"WITH {_EV}, {_IN} SELECT event_type AS key, t, CASE WHEN event_type = 'purchase' THEN 'b' ELSE 'a' END AS target FROM w WHERE event_type IN ('view', 'click', 'purchase')",
    "broken_source": f"WITH {_EV} SELECT event_type AS key, t, event_id, true AS failed FROM ev WHERE event_id < {BROKEN}",
    "iterable_source": f"SELECT row_number() OVER (ORDER BY i) AS pos, 'k' || (i % 3) AS key, {START} + i AS t FROM range(15000) r(i) WHERE i % 3 < 2",
    "tagged_source": """WITH u AS (SELECT msg_id AS id, 0 AS k, 'messages' AS topic, msgKey AS key, msgTime AS t FROM messages_two WHERE msgKey IS NOT NULL AND msgTime IS NOT NULL AND text IS NOT NULL
        UNION ALL SELECT beat_id, 1, 'beats', beatKey, beatTime FROM heart_beats WHERE beatKey IS NOT NULL AND beatTime IS NOT NULL),
        g AS (SELECT *, max(t) OVER (ORDER BY id, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM u)
        SELECT row_number() OVER (ORDER BY t, id, k) AS pos, topic, key, t FROM g WHERE m IS NULL OR t >= m""",
}
assert ORACLE.keys() == QUERIES.keys()
