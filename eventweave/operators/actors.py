"""Actors: consumers that may publish events back into the stream.

A columnar actor is a function of frames, so its work is planned by Catalyst. A row actor is a Python component that sees its events one by
one in dispatch order; its rows stream through a task, sorted, and only the component's own state stays in memory.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventweave.topics import PayloadType, Topic

#: Rows that leave a row actor, by kind: "publish", "reject" (before its trigger), "error", "late" (published at shutdown), "fatal" (a
#: failed start or end), and "state", the component itself, for its end or its next batch.
OUT = "ord array<bigint>, t bigint, actor string, target_ord bigint, kind string, topic string, emit bigint, json string, key string"
_COLUMNS = ["ord", "t", "actor", "target_ord", "kind", "topic", "emit", "json", "key"]
#: Stands for the topic of rows that carry a component's state into a batch.
_STATE = "\0state"


class CausalityError(ValueError):
    """An event published for a time before that of the event being handled."""


class Unbound(RuntimeError):
    """A publish before the component was bound to a run."""


class Component:
    """Base of row components. `publish` works while a handler runs.

    Any object with on_event will do; the other calls are made where it has them. Components that have an end to come (on_shutdown or
    on_abort of their own), and all in live runs, are pickled after their events. on_abort is a best effort on the way out of a failed run.
    """

    _publish: Callable[[str, dict[str, Any]], None] | None = None

    def publish(self, topic: str, payload: dict[str, Any]) -> None:
        if self._publish is None:
            raise Unbound("publish before registration")
        self._publish(topic, payload)

    def on_startup(self, start_ms: int) -> None: ...

    def on_event(self, topic: str, payload: dict[str, Any]) -> None: ...

    def on_shutdown(self, last_ms: int) -> None: ...

    def on_abort(self) -> None: ...


@dataclass
class Actor:
    """``subscriptions`` and ``publications`` map topics to keys, None standing for all."""

    name: str
    subscriptions: dict[Topic, list[str] | None] = field(default_factory=dict)
    publications: dict[Topic, list[str] | None] = field(default_factory=dict)
    high_priority: bool = False


@dataclass
class ColumnarActor(Actor):
    """``fn(topic name, events)`` gives {topic name: frame}; events have ord, topic, key, t and payload.

    A frame has ord and t of the trigger, emit (the ordinal among the trigger's emissions) and payload; None publishes nothing.
    """

    fn: Callable[[str, DataFrame], dict[str, DataFrame] | None] = field(default=lambda name, events: None)


@dataclass
class RowActor(Actor):
    """``make`` builds the component, once per key if ``by_key``, else once. Handler errors are isolated: they become error rows."""

    make: Callable[[], Any] = Component
    by_key: bool = False


def echo(name: str, topic: Topic, out: Topic, text: str = "text", delay_ms: int = 0, keys: list[str] | None = None, high_priority: bool = False) -> ColumnarActor:
    """Publishes for each event of ``topic`` a message on ``out`` of the same key, ``delay_ms`` later, whose text sums the event up."""
    kind = out.payload

    def fn(name: str, events: DataFrame) -> dict[str, DataFrame]:
        values = {kind.key: F.col("key"), kind.time: F.col("t") + delay_ms, text: F.concat(F.lit(f"{name} :: "), F.to_json("payload"))}
        payload = F.struct(*[values[f.name].cast(f.dataType).alias(f.name) if f.name in values else F.lit(None).cast(f.dataType).alias(f.name) for f in kind.schema.fields])
        return {out.name: events.select("ord", "t", F.lit(0).cast("bigint").alias("emit"), payload.alias("payload"))}

    return ColumnarActor(name, {topic: keys}, {out: None}, high_priority, fn)


@dataclass(frozen=True)
class Member:
    """A row actor as its task needs it. ``place`` is that of dispatch, ``index`` that of registration."""

    name: str
    make: Callable[[], Any]
    place: int
    index: int
    subscribed: dict[str, frozenset[str] | None]
    published: dict[str, PayloadType]


def _wants(m: Member, topic: str, key: str) -> bool:
    return topic in m.subscribed and (m.subscribed[topic] is None or key in m.subscribed[topic])


def check_payload(kind: PayloadType, payload: dict[str, Any]) -> tuple[str, int]:
    """Key and time of a payload given as a dict; raises ValueError where a required field is null or parallel lists differ in length."""
    if gone := [c for c in dict.fromkeys((kind.key, kind.time, *kind.required)) if payload.get(c) is None]:
        raise ValueError(f"{kind.type_id} lacks {gone}")
    for a, b in kind.parallel:
        if payload.get(b) is not None and len(payload[a]) != len(payload[b]):
            raise ValueError(f"{a} and {b} differ in length")
    return str(payload[kind.key]), int(payload[kind.time])


def _call_if_there(part: Any, name: str, *args: Any) -> None:
    """Life-cycle calls are optional: a bare component need only have on_event."""
    if (call := getattr(part, name, None)) is not None:
        call(*args)


def _outlives(part: Any) -> bool:
    """Whether a component is needed after its events: it has something to do at the end, or in case of an abort."""
    return any(getattr(type(part), c, None) not in (None, getattr(Component, c)) for c in ("on_shutdown", "on_abort"))


def _pack(part: Any) -> str:
    return base64.b64encode(zlib.compress(cloudpickle.dumps(part))).decode()


def _unpack(text: str) -> Any:
    return cloudpickle.loads(zlib.decompress(base64.b64decode(text)))


class _Session:
    """Runs the members over events in order; what they publish to each other joins the order at once.

    ``key`` is that of the components where there is one set per key. Live, derived events keep the order of arrival instead of time.
    """

    def __init__(self, members: list[Member], start: int, end: int, *, by_key: bool = False, key: str | None = None, live: bool = False, keep: bool = False) -> None:
        self.members, self.start, self.end = sorted(members, key=lambda m: m.place), start, end
        self.by_key, self.key, self.live, self.keep = by_key, key, live, keep
        self.parts: dict[str, Any] = {}
        self.heap: list[tuple] = []
        self.rows: list[tuple] = []
        self.dead = False
        # What is published at start has no trigger: keys tell it apart instead, where each has its own components.
        self.origin = (zlib.crc32((key or "").encode()), int(key is not None)) if by_key else ()

    def _row(self, m: Member, ord_: tuple, t: int | None, kind: str, topic: str, count: int, text: str) -> None:
        self.rows.append((list(ord_), t, m.name, m.place, kind, topic, count, text, self.key))

    def _call(self, m: Member, ord_: tuple, t: int | None, call: Callable[[Any], None], fatal: bool = False, late: bool = False) -> None:
        part, count = self.parts[m.name], 0

        def publish(topic: str, payload: dict[str, Any]) -> None:
            nonlocal count
            if topic not in m.published:
                raise KeyError(f"{m.name} does not publish {topic!r}")
            key, when = check_payload(m.published[topic], payload)
            text = json.dumps(payload, default=str)
            if t is not None and when < t:
                self._row(m, ord_, t, "reject", topic, count, text)
                raise CausalityError(f"{topic} at {when} before {t}")
            heard = not late and self.start <= when <= self.end and any(_wants(x, topic, key) for x in self.members)
            if heard and self.by_key and key != self.key:
                raise ValueError(f"{m.name} hears {topic!r} by key and may publish there for {self.key!r} only, not for {key!r}")
            self._row(m, ord_, t, "late" if late else "publish", topic, count, text)
            if heard:
                heapq.heappush(self.heap, ((0 if self.live else when, 1, *ord_, m.place, count), topic, key, when, text))
            count += 1

        try:
            part._publish = publish
        except AttributeError:
            pass  # a bare component that takes no attributes can't publish
        try:
            call(part)
        except Exception as x:
            self._row(m, ord_, t, "fatal" if fatal else "error", type(x).__name__, count, str(x)[:1000])
            if fatal:
                self.abort()
        finally:
            if hasattr(part, "_publish"):
                part._publish = None

    def abort(self) -> None:
        """Tells all members, best effort; nothing is called after it."""
        self.dead = True
        for part in self.parts.values():
            try:
                _call_if_there(part, "on_abort")
            except Exception:  # noqa: BLE001, S110
                pass

    def begin(self, states: dict[str, str] | None = None) -> None:
        """Takes up kept components, or makes them and starts them in order of registration."""
        if states is not None:
            self.parts = {n: _unpack(x) for n, x in states.items()}
            return
        self.parts = {m.name: m.make() for m in self.members}
        for m in sorted(self.members, key=lambda m: m.index):
            if not self.dead:
                self._call(m, self.origin, None, lambda p: _call_if_there(p, "on_startup", self.start), fatal=True)

    def _dispatch(self, ord_: tuple, topic: str, key: str, t: int, text: str) -> None:
        for m in self.members:
            if _wants(m, topic, key):
                self._call(m, ord_, t, lambda p: p.on_event(topic, json.loads(text)))

    def event(self, ord_: tuple, topic: str, key: str, t: int, text: str) -> None:
        while self.heap and not self.dead and self.heap[0][0] < ord_:
            self._dispatch(*heapq.heappop(self.heap))
        if not self.dead:
            self._dispatch(ord_, topic, key, t, text)

    def finish(self) -> None:
        while self.heap and not self.dead:
            self._dispatch(*heapq.heappop(self.heap))
        for m in self.members:
            if not self.dead and (self.keep or _outlives(self.parts[m.name])):
                self._row(m, (), None, "state", "", m.index, _pack(self.parts[m.name]))

    def shutdown(self, at: int) -> None:
        for m in sorted(self.members, key=lambda m: m.index):
            if not self.dead and m.name in self.parts:
                self._call(m, (at, 2, *self.origin), at, lambda p: _call_if_there(p, "on_shutdown", at), fatal=True, late=True)

    def take(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=_COLUMNS).astype({"t": "Int64"})


def run_rows(
    events: DataFrame, members: list[Member], *, by_key: bool, start: int, end: int, states: DataFrame | None = None, live: bool = False, keep: bool = False,
) -> DataFrame:
    """Runs row actors over events (ord, topic, key, t, json), each event once, and gives what they published and what went wrong.

    By key, each key has its own components and keys are spread over tasks; a key's events pass through one task in order without being
    held. Otherwise all events do, since state across keys is one sequence; with no events at all, one component still starts. ``states``
    (rows of kind "state") are components to go on with; ``keep`` asks for them all, else only those that still have an end to come do.
    """
    rows = events.select("ord", "topic", "key", "t", "json")
    nobody = "cast(array() as array<bigint>) ord"
    if states is not None:
        rows = rows.unionByName(states.selectExpr(nobody, f"concat('{_STATE}', actor) topic", "key", "0L t", "json"))
    if by_key:
        ordered = rows.repartition("key").sortWithinPartitions("key", "ord", "topic")
    else:
        # A row without a place in front keeps the task alive if there are no events; it is passed over.
        mark = events.sparkSession.range(1).selectExpr(nobody, "'' topic", "cast(null as string) key", "0L t", "cast(null as string) json")
        ordered = rows.unionByName(mark).repartition(1).sortWithinPartitions("ord", "topic")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, begun, kept = None, False, {}

        def ready() -> None:
            nonlocal begun
            if not begun:
                session.begin(kept or None)
                begun = True

        def fresh(key: str | None) -> _Session:
            return _Session(members, start, end, by_key=by_key, key=key, live=live, keep=keep)

        if not by_key:
            session = fresh(None)
        for pdf in batches:
            for ord_, topic, key, t, text in pdf.itertuples(index=False, name=None):
                if by_key and (session is None or key != session.key):
                    if session is not None:
                        ready()
                        session.finish()
                        yield session.take()
                    session, begun, kept = fresh(key), False, {}
                if topic.startswith(_STATE):
                    kept[topic[len(_STATE) :]] = text
                elif len(ord_):
                    ready()
                    session.event(tuple(int(x) for x in ord_), topic, key, int(t), text)
            if session is not None and begun:
                yield session.take()
        if session is not None:
            ready()
            session.finish()
            yield session.take()

    return ordered.mapInPandas(run, OUT)


def end_rows(states: DataFrame, members: list[Member], *, at: int | None, start: int, end: int) -> DataFrame:
    """The end of components kept as states: on_shutdown with the run's last time ``at``, in order of registration, or on_abort if it is None.

    What is published at shutdown comes behind the run's last event and is heard by nobody: it gives rows of kind "late".
    """
    by_name = {m.name: m for m in members}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for actor, key, text in pdf.itertuples(index=False, name=None):
                session = _Session([by_name[actor]], start, end, by_key=key is not None, key=key)
                session.begin({actor: text})
                if at is None:
                    session.abort()
                else:
                    session.shutdown(at)
                yield session.take()

    # One component without a key per actor: these end one after another. Those by key are spread.
    alone = states.where("key is null").repartition(1).sortWithinPartitions("emit").select("actor", "key", "json")
    spread = states.where("key is not null").select("actor", "key", "json").repartition("key")
    return alone.mapInPandas(run, OUT).unionByName(spread.mapInPandas(run, OUT))


def members_of(actors: list[RowActor], places: dict[str, int], indices: dict[str, int]) -> list[Member]:
    return [
        Member(a.name, a.make, places[a.name], indices[a.name], {t.name: None if k is None else frozenset(k) for t, k in a.subscriptions.items()}, {t.name: t.payload for t in a.publications})
        for a in actors
    ]
