"""A run: sources, sinks and actors, registered once and turned into frames.

The merge is a union of sorted keys, not a loop: sources are clipped and guarded, keyed, and united; actors add derived events, topic by
topic in the order in which their topics depend on each other; positions and deliveries follow from the keys.
"""

from __future__ import annotations

import enum
import time
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweave.functions.codec import parse, valid
from eventweave.operators.actors import Actor, ColumnarActor, Component, Member, RowActor, end_rows, members_of, run_rows
from eventweave.operators.merge import derived_key, in_window, monotonic_guard, source_key, with_position
from eventweave.operators.routing import Routes, Target, deliver
from eventweave.report import ComponentReporter
from eventweave.session import materialise
from eventweave.sources import Source
from eventweave.sources.sinks import Sink
from eventweave.topics import Topic


class Status(enum.Enum):
    """BLANK until planned (INITIALIZED, then PRESTART while sources are read); STARTED while events are dispatched, WRAP_UP once the last is,
    FINALIZE while components and sinks end, then COMPLETE, or STOPPED after a failure. A live run may also be PAUSED."""

    BLANK, INITIALIZED, PRESTART, STARTED, WRAP_UP, PAUSED, FINALIZE, STOPPED, COMPLETE = range(9)


class Mode(enum.Enum):
    COMPRESSED_TIME, REAL_TIME = range(2)


class RunFailed(RuntimeError):
    """A sink failed, or a component at its start or end; the run is STOPPED."""


class NotOver(ValueError):
    """A replay of a window that isn't over yet; such a run is live."""


NO_ERRORS = "actor string, ord array<bigint>, t bigint, kind string, message string"


def mode_of(end: int, now_ms: int | None = None) -> Mode:
    """Replay if the window is over, live otherwise."""
    return Mode.COMPRESSED_TIME if (now_ms if now_ms is not None else int(time.time() * 1000)) > end else Mode.REAL_TIME


@dataclass
class Result:
    """What a run gave. ``events`` has every accepted event once: ord, topic, key, t, gen, json; ``failed_sources`` tells early ends."""

    events: DataFrame
    deliveries: DataFrame
    errors: DataFrame
    status: Status
    failed_sources: dict[str, str]
    last_time: int | None = None


@dataclass
class Run:
    start: int
    end: int
    name: str = "run"
    status: Status = Status.BLANK
    sources: list[tuple[Source, bool]] = field(default_factory=list)
    sinks: list[Sink] = field(default_factory=list)
    actors: list[Actor] = field(default_factory=list)
    publishers: Routes = field(default_factory=lambda: Routes("source"))
    subscribers: Routes = field(default_factory=lambda: Routes("sink"))
    #: Row actors that still have an end to come: their members and components, of one call of `plan`.
    ends: list[tuple[list[Member], DataFrame]] = field(default_factory=list, init=False, repr=False)

    def __post_init__(self) -> None:
        self.report = ComponentReporter(self.name)

    def source(self, source: Source, high_priority: bool = False) -> Run:
        for topic, keys in source.topics.items():
            self.publishers.register(source, topic, keys)
        if all(s is not source for s, _ in self.sources):
            self.sources.append((source, high_priority))
        return self

    def sink(self, sink: Sink, topic: Topic, keys: list[str] | None = None) -> Run:
        self.subscribers.register(sink, topic, keys)
        if all(s is not sink for s in self.sinks):
            self.sinks.append(sink)
        return self

    def unregister(self, owner: Source | Sink, topic: Topic, keys: list[str] | None = None) -> Run:
        (self.publishers if isinstance(owner, Source) else self.subscribers).unregister(owner, topic, keys)
        return self

    def actor(self, actor: Actor) -> Run:
        if not actor.subscriptions and not actor.publications:
            raise ValueError(f"{actor.name} neither subscribes nor publishes")
        if any(a is actor or a.name == actor.name for a in self.actors):
            raise ValueError(f"{actor.name} is registered already")
        self.actors.append(actor)
        return self

    def _check(self) -> None:
        for a in self.actors:
            for topic, keys in a.publications.items():
                for (t, k), s in self.publishers.owners.items():
                    if t == topic and (k is None or keys is None or k in keys):
                        raise ValueError(f"{a.name} publishes on ({topic.name}, {k}), which is fed by {s.name}")
        names: dict[str, Topic] = {}
        for topic in [*(t for s, _ in self.sources for t in s.topics), *(t for a in self.actors for t in (*a.subscriptions, *a.publications)), *(t for t, _ in self.subscribers.owners)]:
            if names.setdefault(topic.name, topic) != topic:
                raise ValueError(f"topic {topic.name} has two payload types")
        self.topics = names

    @property
    def mode(self) -> Mode:
        return mode_of(self.end)

    def _check_cycle(self, group: list[Actor]) -> bool:
        """Whether a group of actors runs by key."""
        rows = [a for a in group if isinstance(a, RowActor)]
        cyclic = len(group) > 1 or bool(set(group[0].publications) & set(group[0].subscriptions))
        if cyclic and len(rows) < len(group):
            raise ValueError(f"actors in a cycle must be row actors: {[a.name for a in group]}")
        if len({a.by_key for a in rows}) > 1:
            raise ValueError(f"actors in a cycle must all have components by key, or none: {[a.name for a in group]}")
        return bool(rows) and rows[0].by_key

    def _targets(self) -> list[Target]:
        out = [Target(t.name, k, s.name, "sink", -1) for (t, k), s in self.subscribers.owners.items()]
        for place, a in enumerate(self._ordered()):
            for t, keys in a.subscriptions.items():
                out += [Target(t.name, k, a.name, "actor", place) for k in ([None] if keys is None else dict.fromkeys(keys))]
        return out

    def _ordered(self) -> list[Actor]:
        return sorted(self.actors, key=lambda a: not a.high_priority)

    def _groups(self) -> list[list[Actor]]:
        """Actors in the order in which their topics depend on each other; those in a cycle together."""
        feeds = {a.name: {b.name for b in self.actors if set(a.publications) & set(b.subscriptions)} for a in self.actors}
        reach: dict[str, set[str]] = {}
        for a in feeds:
            seen, todo = set(), [a]
            while todo:
                for b in feeds[todo.pop()]:
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            reach[a] = seen
        groups: list[list[Actor]] = []
        for a in self._ordered():
            for g in groups:
                if g[0].name in reach[a.name] and a.name in reach[g[0].name]:
                    g.append(a)
                    break
            else:
                groups.append([a])
        done: list[list[Actor]] = []
        while groups:
            free = next(g for g in groups if not any(h is not g and any(x.name in reach[h[0].name] for x in g) for h in groups))
            groups.remove(free)
            done.append(free)
        return done

    def _read(self, spark: SparkSession) -> tuple[dict[str, list[DataFrame]], dict[str, str]]:
        streams: dict[str, list[DataFrame]] = {n: [] for n in self.topics}
        failed = {}
        for index, (source, high) in enumerate(self.sources):
            got = source.read(spark, self.start, self.end)
            if got.failure:
                failed[source.name] = got.failure
                self.report.severe(lambda s=source.name, f=got.failure: f"{s} ended early: {f}")
            frames = {n: in_window(f, self.start, self.end) for n, f in got.frames.items()}
            if len(frames) == 1:
                frames = {n: monotonic_guard(f, "seq") for n, f in frames.items()}
            else:
                light = reduce(DataFrame.unionByName, [f.select("seq", "t") for f in frames.values()])
                kept = monotonic_guard(light, "seq").select("seq")
                frames = {n: f.join(kept, "seq", "left_semi") for n, f in frames.items()}
            for n, f in frames.items():
                order = [F.col(c) for c in f.columns if c.startswith("seq")]
                key = source_key(F.col("t"), 0 if high else 1, index, *order)
                streams[n].append(f.select(key.alias("ord"), F.lit(n).alias("topic"), "key", "t", F.lit(0).alias("gen"), "payload"))
        return streams, failed

    def _stream(self, streams: dict[str, list[DataFrame]], topic: Topic, keys: list[str] | None) -> DataFrame | None:
        if not streams[topic.name]:
            return None
        df = reduce(DataFrame.unionByName, streams[topic.name])
        return df if keys is None else df.where(F.col("key").isin(*keys))

    def _derive(self, made: DataFrame, place: int, topic: Topic, gen: int) -> DataFrame:
        """Envelope of published rows (ord and t of the trigger, emit, payload); ord is empty for what was published at start."""
        kind = topic.payload
        rows = made.select(F.col("payload")[kind.time].alias("t"), F.col("payload")[kind.key].cast("string").alias("key"), F.col("ord").alias("o"), F.col("emit"), "payload")
        rows = in_window(rows, self.start, self.end)
        return rows.select(derived_key(F.col("t"), F.col("o"), F.lit(place), F.col("emit")).alias("ord"), F.lit(topic.name).alias("topic"), "key", "t", F.lit(gen).alias("gen"), "payload")

    def plan(self, spark: SparkSession) -> Result:
        """Builds the frames of events and deliveries; row actors run here, since their calls may only happen once. Raises RunFailed if one fails to start or end."""
        result = self._plan(spark)
        try:
            self._shutdown(result)
        except RunFailed:
            self._fail(spark, result)
            raise
        self.status = result.status = Status.INITIALIZED
        return result

    def _plan(self, spark: SparkSession) -> Result:
        self._check()
        by_key = [self._check_cycle(g) for g in self._groups()]
        self.status, self.ends = Status.PRESTART, []
        streams, failed = self._read(spark)
        errors = [spark.createDataFrame([], NO_ERRORS)]
        self.status = Status.STARTED
        try:
            for gen, (group, keyed) in enumerate(zip(self._groups(), by_key), start=1):
                if isinstance(group[0], RowActor):
                    self._run_rows(spark, group, keyed, streams, errors, gen)
                else:
                    for a in group:
                        self._run_columns(a, self._places()[a.name], streams, errors, gen)
        except RunFailed:
            self._fail(spark)
            raise
        every = [f.select("ord", "topic", "key", "t", "gen", F.to_json("payload").alias("json")) for fs in streams.values() for f in fs]
        events = reduce(DataFrame.unionByName, every) if every else spark.createDataFrame([], "ord array<bigint>, topic string, key string, t bigint, gen int, json string")
        return Result(events, deliver(events, self._targets()), reduce(DataFrame.unionByName, errors), self.status, failed)

    def _places(self) -> dict[str, int]:
        return {a.name: i for i, a in enumerate(self._ordered())}

    def _members(self, rows: list[RowActor]) -> list[Member]:
        return members_of(rows, self._places(), {a.name: i for i, a in enumerate(self.actors)})

    def _run_columns(self, a: ColumnarActor, place: int, streams: dict, errors: list, gen: int) -> None:
        for topic, keys in a.subscriptions.items():
            events = self._stream(streams, topic, keys)
            for name, made in ((events is not None and a.fn(topic.name, events)) or {}).items():
                out = next((t for t in a.publications if t.name == name), None)
                if out is None:
                    raise ValueError(f"{a.name} does not declare {name!r}")
                good = valid(F.col("payload"), out.payload)
                late = good & (F.col("payload")[out.payload.time] < F.col("t"))
                kind = F.when(late, "reject").otherwise("error")
                errors.append(made.where(late | ~good).select(F.lit(a.name).alias("actor"), "ord", "t", kind.alias("kind"), F.to_json("payload").alias("message")))
                streams[name].append(self._derive(made.where(good & ~late), place, out, gen))

    @staticmethod
    def _heard(rows: list[RowActor]) -> dict[Topic, set[str] | None]:
        """Topics and keys that any of the actors hears, None standing for all keys."""
        wanted: dict[Topic, set[str] | None] = {}
        for a in rows:
            for topic, keys in a.subscriptions.items():
                wanted[topic] = None if keys is None or wanted.get(topic, set()) is None else {*wanted.get(topic, ()), *keys}
        return wanted

    def _run_rows(self, spark: SparkSession, rows: list[RowActor], by_key: bool, streams: dict, errors: list, gen: int) -> None:
        parts = [self._stream(streams, t, None if k is None else sorted(k)) for t, k in self._heard(rows).items()]
        light = [p.select("ord", "topic", "key", "t", F.to_json("payload").alias("json")) for p in parts if p is not None]
        events = reduce(DataFrame.unionByName, light) if light else spark.createDataFrame([], "ord array<bigint>, topic string, key string, t bigint, json string")
        members, places = self._members(rows), self._places()
        out = materialise(run_rows(events, members, by_key=by_key, start=self.start, end=self.end), "actors")
        self.ends.append((members, out.where("kind = 'state'")))
        self._raise_fatal(out)
        errors.append(noted(out))
        for a in rows:
            for topic in a.publications:
                mine = out.where((F.col("kind") == "publish") & (F.col("actor") == a.name) & (F.col("topic") == topic.name)).withColumn("payload", parse(F.col("json"), topic.payload))
                # What Python takes for a payload may still not fit the fields' types.
                errors.append(mine.where("payload is null").select("actor", "ord", "t", F.lit("error").alias("kind"), F.concat_ws(": ", "topic", "json").alias("message")))
                streams[topic.name].append(self._derive(mine.where("payload is not null"), places[a.name], topic, gen))

    def _raise_fatal(self, out: DataFrame) -> None:
        if (x := out.where("kind = 'fatal'").select("actor", "topic", "json").first()) is not None:
            raise RunFailed(f"{x.actor}: {x.topic}: {x.json}")

    def _shutdown(self, result: Result) -> None:
        """on_shutdown of the row actors that have one, with the time of the run's last event, or its end if there was none."""
        self.status = Status.WRAP_UP
        waiting = [(m, s) for m, s in self.ends if any(_ends_itself(x) for x in m)]
        if not waiting:
            return
        if result.last_time is None:
            result.last_time = result.events.agg(F.max("t")).first()[0]
        self.status = Status.FINALIZE
        for members, states in waiting:
            out = materialise(end_rows(states, members, at=self.end if result.last_time is None else result.last_time, start=self.start, end=self.end), "ends")
            self._raise_fatal(out)
            result.errors = result.errors.unionByName(noted(out))

    def _fail(self, spark: SparkSession, result: Result | None = None) -> None:
        """Tells row actors that are through with their events of the run's failure, best effort."""
        self.status = Status.STOPPED
        if result is not None:
            result.status = Status.STOPPED
        for members, states in self.ends:
            try:
                end_rows(states, members, at=None, start=self.start, end=self.end).write.format("noop").mode("overwrite").save()
            except Exception as x:  # noqa: BLE001
                self.report.warn(lambda x=x: f"abort: {x}")

    def execute(self, spark: SparkSession, now_ms: int | None = None) -> Result:
        """Plans, then writes every sink. Raises RunFailed, with the status STOPPED, if a sink fails, or a component at its start or end.

        Actor errors don't: they are rows of ``errors``. A window that isn't over at ``now_ms`` (the clock, if None) is refused: `launch` runs it live.
        """
        if mode_of(self.end, now_ms) is Mode.REAL_TIME:
            raise NotOver(f"{self.name} ends at {self.end}, which is still to come")
        result = self._plan(spark)
        result.events = materialise(result.events, "events")
        result.deliveries = deliver(result.events, self._targets())
        try:
            for s in self.sinks:
                s.write(result.deliveries.where((F.col("target_kind") == "sink") & (F.col("target") == s.name)))
                if s.errors is not None:
                    result.errors = result.errors.unionByName(s.errors)
            result.last_time = result.events.agg(F.max("t")).first()[0]
            self._shutdown(result)
        except Exception as x:
            self._fail(spark, result)
            self.report.fatal(lambda: f"run failed: {x}")
            raise x if isinstance(x, RunFailed) else RunFailed(str(x)) from x
        self.status = result.status = Status.COMPLETE
        return result

    def launch(self, spark: SparkSession, path: str, now_ms: int | None = None) -> Any:
        """Runs by the mode that the window calls for: a replay gives its Result, a live run a `LiveRun` that has started on all sources."""
        if mode_of(self.end, now_ms) is Mode.COMPRESSED_TIME:
            return self.execute(spark, now_ms)
        from eventweave.streaming.live import LiveRun

        live = LiveRun(self, path)
        live.start(reduce(DataFrame.unionByName, [f for s, _ in self.sources for f in s.stream(spark, self.start, self.end)]))
        return live

    def delivery_log(self, spark: SparkSession) -> DataFrame:
        """pos, topic, key, t, target, target_kind, target_ord of every delivery; events without a target take a position too."""
        result = self.plan(spark)
        return deliver(with_position(result.events.select("ord", "topic", "key", "t", "gen")), self._targets())


def noted(out: DataFrame) -> DataFrame:
    """Error rows of what row actors gave."""
    return out.where("kind in ('reject', 'error', 'late', 'fatal')").select("actor", "ord", "t", "kind", F.concat_ws(": ", "topic", "json").alias("message"))


def _ends_itself(m: Member) -> bool:
    """Whether the member's component may have an on_shutdown of its own; told from what ``make`` is, if that is a class."""
    return not (isinstance(m.make, type) and getattr(m.make, "on_shutdown", None) in (None, Component.on_shutdown))


__all__ = ["Mode", "NotOver", "Result", "Run", "RunFailed", "Status", "mode_of"]
