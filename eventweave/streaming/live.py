"""Live runs on Structured Streaming: events are taken in order of arrival, micro-batch by micro-batch.

There is no guard against backward times here and no order by time. Events before the window are dropped, and the first event past its end,
from whatever source, closes the run: what arrived before it is still dispatched, what came after is not. Each batch writes its
deliveries, error rows, components and the state after it under its own number, so a batch that is run again after a failure overwrites
itself.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventweave.functions.codec import parse, parse_tagged, valid
from eventweave.operators.actors import OUT, ColumnarActor, RowActor, end_rows, run_rows
from eventweave.operators.merge import derived_key, with_position
from eventweave.operators.routing import deliver
from eventweave.plans.run import NO_ERRORS, Mode, Run, RunFailed, Status, noted
from eventweave.session import clear_scratch, scratch_mark
from eventweave.topics import HEART_BEAT, Topic


def live_jsonl(spark: SparkSession, topic: Topic, folder: str, keys: list[str] | None = None, files_per_batch: int = 1, tagged: bool = False) -> DataFrame:
    """Events of JSON line files as they appear in a folder; broken lines are dropped. The rate limit bounds a batch."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    read = parse_tagged if tagged else parse
    made = lines.select(read(F.col("value"), topic.payload).alias("payload")).where("payload is not null")
    return _event(made, topic, keys)


def live_heartbeats(spark: SparkSession, topic: Topic, key: str, period_ms: int, first: int, end: int | None = None) -> DataFrame:
    """Beats of a key at first, first + period, ... up to the end: those already due come at once, the others when their time comes.

    A clock ticks a few times a period; each tick gives the beats that fell due since the tick before, the first all that are past due.
    """
    if period_ms <= 0:
        raise ValueError("the period must be above 0")
    rate = min(20, max(1, -(-4000 // period_ms)))
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rate).option("numPartitions", 1).load()
    now = F.unix_millis("timestamp")
    due = lambda ms: F.call_function("div", ms - F.lit(first).cast("bigint"), F.lit(period_ms).cast("bigint"))
    to = F.when(now < first, -1).otherwise(due(now))
    # The tick before, by the same arithmetic: the source's n-th row stands n / rate seconds behind its first.
    value = F.col("value")
    begun = F.col("timestamp") - F.make_dt_interval(secs=(value / rate).cast("decimal(18,6)"))
    last = F.unix_millis(begun + F.make_dt_interval(secs=((value - 1) / rate).cast("decimal(18,6)")))
    past = F.when((value == 0) | (last < first), -1).otherwise(due(last))
    if end is not None:
        to = F.least(to, F.lit((end - first) // period_ms))
    beats = ticks.select(to.alias("to"), past.alias("past")).where("to > past").select(F.explode(F.sequence(F.col("past") + 1, F.col("to"))).alias("n"))
    beat = F.struct(F.lit(key).alias(HEART_BEAT.key), (F.lit(first).cast("bigint") + F.col("n") * period_ms).alias(HEART_BEAT.time))
    return _event(beats.select(beat.alias("payload")), topic, None)


def _event(df: DataFrame, topic: Topic, keys: list[str] | None) -> DataFrame:
    kind = topic.payload
    out = df.where(valid(F.col("payload"), kind)).select(
        F.lit(topic.name).alias("topic"), F.col("payload")[kind.key].cast("string").alias("key"), F.col("payload")[kind.time].alias("t"), F.to_json("payload").alias("json")
    )
    return out if keys is None else out.where(F.col("key").isin(*keys))


@dataclass
class LiveRun:
    """Dispatches a stream of events (topic, key, t, json) by the routes of a run; sinks, actors and what they publish work as in a replay.

    A batch's events come first, in order of arrival, and what actors publish follows in order of its triggers, topic by topic as they depend
    on each other. Row actors keep their components from batch to batch. Everything is kept under ``path``, a shared folder.
    """

    run: Run
    path: str
    query: StreamingQuery | None = field(default=None, init=False)
    _args: tuple = field(default=(), init=False, repr=False)
    _failure: Exception | None = field(default=None, init=False, repr=False)

    def start(self, events: DataFrame, *, available_now: bool = False, every: str | None = None) -> StreamingQuery:
        self.run._check()
        for group in self.run._groups():
            self.run._check_cycle(group)
        self.run.status = Status.PRESTART
        self._args = (events, available_now, every)
        spark = events.sparkSession
        if self._latest(spark) is None:
            self._write_json(spark, "state", -1, {"count": 0, "closed": False, "last": None})
            try:
                self._components(spark)
                for s in self.run.sinks:
                    s.opened(spark)
            except Exception as x:
                self._stop(spark, x)
                raise
        return self._begin()

    def _begin(self) -> StreamingQuery:
        events, available_now, every = self._args
        writer = events.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.path}/checkpoint")
        if available_now:
            writer = writer.trigger(availableNow=True)
        elif every:
            writer = writer.trigger(processingTime=every)
        self.run.status = Status.STARTED
        self.query = writer.start()
        return self.query

    def pause(self) -> None:
        """Stops taking events; `resume` goes on where this left off."""
        self.query.stop()
        self.run.status = Status.PAUSED

    def resume(self) -> StreamingQuery:
        return self._begin()

    def wait(self, *, lead_ms: int = 1000, timeout_s: float | None = None) -> Status:
        """Waits for the run's end, then ends components and sinks. It ends at the first event past its end, when its input does, or
        ``lead_ms`` after its end by the clock. Raises RunFailed, after telling actors and sinks, if a sink or a component failed."""
        spark, until = self._args[0].sparkSession, None if timeout_s is None else time.monotonic() + timeout_s
        try:
            # Only a run on the clock ends by it; what is there already is taken whole.
            by_clock = not self._args[1]
            while self.query.isActive:
                self.query.awaitTermination(1)
                over = by_clock and time.time() * 1000 > self.run.end + lead_ms
                if over or (self._latest(spark) or {}).get("closed") or (until is not None and time.monotonic() > until):
                    self.query.stop()
            if self.query.exception() is not None:
                raise RunFailed(str(self._failure or self.query.exception()))
            self.run.status = Status.WRAP_UP
            self._finish(spark)
        except Exception as x:
            self._stop(spark, x)
            raise x if isinstance(x, RunFailed) else RunFailed(str(x)) from x
        self.run.status = Status.COMPLETE
        return self.run.status

    @property
    def mode(self) -> Mode:
        return self.run.mode

    def deliveries(self, spark: SparkSession) -> DataFrame:
        """All deliveries so far: pos, ord, topic, key, t, json, target, target_kind, target_ord, batch."""
        return spark.read.option("basePath", f"{self.path}/deliveries").parquet(f"{self.path}/deliveries/batch=*")

    def errors(self, spark: SparkSession) -> DataFrame:
        """All error rows so far: actor, ord, t, kind, message, batch."""
        return spark.read.option("basePath", f"{self.path}/errors").schema(NO_ERRORS + ", batch bigint").parquet(f"{self.path}/errors/batch=*")

    # What the run keeps between batches.

    def _latest(self, spark: SparkSession) -> dict[str, Any] | None:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return None
        numbers = [int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(at) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        return None if not numbers else {"batch": max(numbers), **self._read_json(spark, "state", max(numbers))}

    def _write_json(self, spark: SparkSession, what: str, batch: int, value: dict[str, Any]) -> None:
        spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{what}/batch={batch}")

    def _read_json(self, spark: SparkSession, what: str, batch: int) -> dict[str, Any]:
        return json.loads(spark.read.text(f"{self.path}/{what}/batch={batch}").first()[0])

    def _rows(self) -> list[list[RowActor]]:
        return [g for g in self.run._groups() if isinstance(g[0], RowActor)]

    def _kept(self, spark: SparkSession, place: int, batch: int) -> DataFrame:
        return spark.read.schema(OUT).parquet(f"{self.path}/components/group={place}/batch={batch}")

    def _components(self, spark: SparkSession) -> None:
        """Makes and starts the components that aren't by key, before any event; those by key start with their key."""
        run = self.run
        none = spark.createDataFrame([], "ord array<bigint>, topic string, key string, t bigint, json string")
        for place, group in enumerate(self._rows()):
            made = none.selectExpr("ord", "cast(null as bigint) t", "'' actor", "0L target_ord", "'' kind", "topic", "0L emit", "json", "key")
            if not group[0].by_key:
                made = run_rows(none, run._members(group), by_key=False, start=run.start, end=run.end, live=True, keep=True)
            made.write.mode("overwrite").parquet(f"{self.path}/components/group={place}/batch=-1")
            run._raise_fatal(self._kept(spark, place, -1))

    def _batch(self, df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        mark = scratch_mark(spark)
        try:
            self._take(df, batch_id)
        except Exception as x:
            self._failure = x
            raise
        finally:
            clear_scratch(spark, mark)

    def _take(self, df: DataFrame, batch_id: int) -> None:
        spark, run = df.sparkSession, self.run
        state = self._read_json(spark, "state", batch_id - 1)
        # Arrival order in a batch is that of its rows as the source gave them; written once, so that numbers don't change.
        arrived = df.withColumn("seq", F.monotonically_increasing_id()).withColumn("arrived_ms", F.lit(int(time.time() * 1000)))
        arrived.write.mode("overwrite").parquet(f"{self.path}/arrived/batch={batch_id}")
        rows = spark.read.schema(arrived.schema).parquet(f"{self.path}/arrived/batch={batch_id}")
        errors = [spark.createDataFrame([], NO_ERRORS)]
        stop = 0 if state["closed"] else rows.where(F.col("t") > run.end).agg(F.min("seq")).first()[0]
        state["closed"] = state["closed"] or stop is not None
        kept = rows.where(F.col("t") >= run.start)
        kept = kept if stop is None else kept.where(F.col("seq") < stop)
        nought = F.lit(0).cast("bigint")
        every = kept.select(F.array(nought, nought, F.col("seq")).alias("ord"), "topic", "key", "t", "json")
        place = 0
        for group in run._groups():
            if isinstance(group[0], RowActor):
                every = every.unionByName(self._by_row(group, place, batch_id, every, errors))
                place += 1
            else:
                for a in group:
                    every = every.unionByName(self._published(a, run._places()[a.name], every, errors))
        numbered = with_position(every).withColumn("pos", F.col("pos") + state["count"])
        deliver(numbered, run._targets()).write.mode("overwrite").parquet(f"{self.path}/deliveries/batch={batch_id}")
        done = spark.read.parquet(f"{self.path}/deliveries/batch={batch_id}")
        for s in run.sinks:
            s.errors = None
            s.write_batch(done.where((F.col("target_kind") == "sink") & (F.col("target") == s.name)), batch_id)
            if s.errors is not None:
                errors.append(s.errors)
        reduce(DataFrame.unionByName, errors).write.mode("overwrite").parquet(f"{self.path}/errors/batch={batch_id}")
        got = every.agg(F.count(F.lit(1)), F.max_by("t", "ord")).first()
        state["count"] += got[0]
        state["last"] = state["last"] if got[1] is None else got[1]
        self._write_json(spark, "state", batch_id, state)

    def _after(self, made: DataFrame, place: int, topic: Topic) -> DataFrame:
        """Envelope of published rows: behind all that arrived in this batch, in order of the triggers."""
        kind, at = topic.payload, F.col("payload")[topic.payload.time]
        return made.where((at >= self.run.start) & (at <= self.run.end)).select(
            derived_key(F.lit(0), F.col("ord"), F.lit(place), F.col("emit")).alias("ord"), F.lit(topic.name).alias("topic"), F.col("payload")[kind.key].cast("string").alias("key"), at.alias("t"), F.to_json("payload").alias("json"),
        )

    def _published(self, a: ColumnarActor, place: int, events: DataFrame, errors: list[DataFrame]) -> DataFrame:
        out = events.limit(0)
        for topic, keys in a.subscriptions.items():
            mine = events.where(F.col("topic") == topic.name).withColumn("payload", parse(F.col("json"), topic.payload))
            mine = mine if keys is None else mine.where(F.col("key").isin(*keys))
            for name, made in (a.fn(topic.name, mine) or {}).items():
                target = next((t for t in a.publications if t.name == name), None)
                if target is None:
                    raise ValueError(f"{a.name} does not declare {name!r}")
                good = valid(F.col("payload"), target.payload)
                late = good & (F.col("payload")[target.payload.time] < F.col("t"))
                kind = F.when(late, "reject").otherwise("error")
                errors.append(made.where(late | ~good).select(F.lit(a.name).alias("actor"), "ord", "t", kind.alias("kind"), F.to_json("payload").alias("message")))
                out = out.unionByName(self._after(made.where(good & ~late), place, target))
        return out

    def _by_row(self, group: list[RowActor], place: int, batch_id: int, events: DataFrame, errors: list[DataFrame]) -> DataFrame:
        """Runs a group of row actors over a batch with the components of the batch before; keys that the batch lacks keep theirs as they are."""
        run, spark, places = self.run, events.sparkSession, self.run._places()
        heard = F.lit(False)
        for topic, keys in run._heard(group).items():
            heard = heard | ((F.col("topic") == topic.name) & (F.lit(True) if keys is None else F.col("key").isin(*sorted(keys))))
        mine, before = events.where(heard), self._kept(spark, place, batch_id - 1).where("kind = 'state'")
        if group[0].by_key:
            there = mine.select("key").distinct()
            idle, before = before.join(there, "key", "left_anti").select(*before.columns), before.join(there, "key", "left_semi").select(*before.columns)
        made = run_rows(mine, run._members(group), by_key=group[0].by_key, start=run.start, end=run.end, states=before, live=True, keep=True)
        made = made.unionByName(idle) if group[0].by_key else made
        # What was published at the start of components goes with the first batch.
        if batch_id == 0:
            made = made.unionByName(self._kept(spark, place, -1).where("kind <> 'state'"))
        made.write.mode("overwrite").parquet(f"{self.path}/components/group={place}/batch={batch_id}")
        done = self._kept(spark, place, batch_id)
        run._raise_fatal(done)
        errors.append(noted(done))
        out = events.limit(0)
        for a in group:
            for topic in a.publications:
                rows = done.where((F.col("kind") == "publish") & (F.col("actor") == a.name) & (F.col("topic") == topic.name)).withColumn("payload", parse(F.col("json"), topic.payload))
                errors.append(rows.where("payload is null").select("actor", "ord", "t", F.lit("error").alias("kind"), F.concat_ws(": ", "topic", "json").alias("message")))
                out = out.unionByName(self._after(rows.where("payload is not null"), places[a.name], topic))
        return out

    def _finish(self, spark: SparkSession) -> None:
        run, state = self.run, self._latest(spark)
        run.status = Status.FINALIZE
        at = run.end if state["last"] is None else state["last"]
        for place, group in enumerate(self._rows()):
            out = end_rows(self._kept(spark, place, state["batch"]).where("kind = 'state'"), run._members(group), at=at, start=run.start, end=run.end)
            out.write.mode("overwrite").parquet(f"{self.path}/ends/group={place}")
            run._raise_fatal(spark.read.schema(OUT).parquet(f"{self.path}/ends/group={place}"))
        for s in run.sinks:
            s.closed(spark)

    def _stop(self, spark: SparkSession, failure: Exception) -> None:
        """Tells actors and sinks of a failure, best effort."""
        run, state = self.run, self._latest(spark)
        run.status = Status.STOPPED
        run.report.fatal(lambda: f"live run failed: {failure}")

        def tell(what: Any, *args: Any) -> None:
            try:
                what(*args)
            except Exception as x:  # noqa: BLE001
                run.report.warn(lambda x=x: f"abort: {x}")

        for place, group in enumerate(self._rows()):
            tell(lambda place=place, group=group: end_rows(self._kept(spark, place, state["batch"]).where("kind = 'state'"), run._members(group), at=None, start=run.start, end=run.end).write.format("noop").mode("overwrite").save())
        for s in run.sinks:
            tell(s.closed, spark, failure)


def running_counts(events: DataFrame) -> DataFrame:
    """Stateful: (topic, key, seen, last_t) per batch and key, counted over the whole stream; state is one row per key."""

    def update(group: tuple[str, str], batches: Any, state: GroupState) -> Any:
        seen, last = state.get if state.exists else (0, -1)
        for pdf in batches:
            seen, last = seen + len(pdf), max(last, int(pdf["t"].max()))
        state.update((seen, last))
        yield pd.DataFrame({"topic": [group[0]], "key": [group[1]], "seen": [seen], "last_t": [last]})

    return events.select("topic", "key", "t").groupBy("topic", "key").applyInPandasWithState(update, "topic string, key string, seen bigint, last_t bigint", "seen bigint, last_t bigint", "update", GroupStateTimeout.NoTimeout)
