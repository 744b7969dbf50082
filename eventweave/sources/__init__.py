"""Sources and sinks. A source gives one frame per topic: key STRING, t BIGINT, seq BIGINT, extra order columns, payload STRUCT."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from eventweave.functions.codec import parse, parse_tagged, type_id
from eventweave.operators.actors import check_payload
from eventweave.operators.merge import in_window
from eventweave.session import materialise
from eventweave.topics import HEART_BEAT, Topic


class SourceFailed(RuntimeError):
    """A source that can't be read at all."""


@dataclass
class Read:
    """What a source gave: frames by topic name, and why it ended early, if it did."""

    frames: dict[str, DataFrame]
    failure: str | None = None


@dataclass
class Source:
    """Base of sources. ``topics`` maps topics to the keys admitted (None for all). Own bounds are those of the reader, not of the run."""

    name: str
    topics: dict[Topic, list[str] | None] = field(default_factory=dict)

    def read(self, spark: SparkSession, start: int, end: int) -> Read:
        raise NotImplementedError

    def stream(self, spark: SparkSession, start: int, end: int) -> list[DataFrame]:
        """Live events (topic, key, t, json), a frame per topic."""
        raise NotImplementedError(f"{type(self).__name__} has no live form")

    def _envelope(self, df: DataFrame, topic: Topic, payload: Column, *seq: Column) -> DataFrame:
        made = df.select(payload.alias("payload"), *[s.cast("bigint").alias("seq" if i == 0 else f"seq{i}") for i, s in enumerate(seq)])
        kind = topic.payload
        made = made.select(F.col("payload")[kind.key].cast("string").alias("key"), F.col("payload")[kind.time].cast("bigint").alias("t"), *[c for c in made.columns if c != "payload"], "payload")
        keys = self.topics.get(topic)
        return made if keys is None else made.where(F.col("key").isin(*keys))


@dataclass
class FrameSource(Source):
    """Rows of a DataFrame, in the order of ``seq`` (integer columns; the first is the place, the others settle ties).

    ``payload`` maps fields of the topic's payload to columns or names. Rows with a null key or time are no events and are left out.
    """

    df: DataFrame | None = None
    payload: dict[str, str | Column] = field(default_factory=dict)
    seq: list[str | Column] = field(default_factory=list)

    def read(self, spark: SparkSession, start: int, end: int) -> Read:
        (topic,) = self.topics
        col = lambda c: F.col(c) if isinstance(c, str) else c
        kinds = {f.name: f.dataType for f in topic.payload.schema.fields}
        struct = F.struct(*[col(self.payload[n]).cast(kinds[n]).alias(n) if n in self.payload else F.lit(None).cast(kinds[n]).alias(n) for n in kinds])
        return Read({topic.name: self._envelope(self.df, topic, struct, *[col(c) for c in self.seq]).where("key is not null and t is not null")})


@dataclass
class JsonlSource(Source):
    """A file of one JSON payload per line, or tagged ones for several topics.

    In file order: blank lines are passed over; a broken line ends the source, what came before stays; keys not admitted and times before
    the reader's start are passed over; the first admitted time after its end ends the source. ``start`` and ``end`` default to the run's.
    Lines are numbered by file block and order in it, so a long file is read by many tasks.
    """

    path: str = ""
    tagged: bool = False
    start: int | None = None
    end: int | None = None

    def read(self, spark: SparkSession, start: int, end: int) -> Read:
        a, z = start if self.start is None else self.start, end if self.end is None else self.end
        raw = spark.read.text(self.path).select(
            "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("id"),
        )
        # A line's place: bytes of the files before (by name), where its block begins, and its number in the block. A block has no more
        # lines than bytes, so places rise through the file. The table has one row per block.
        blocks = raw.groupBy("file", "size", "block").agg(F.min("id").alias("low"))
        files = blocks.groupBy("file").agg(F.max("size").alias("bytes"))
        files = files.select("file", F.coalesce(F.sum("bytes").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        places = blocks.join(files, "file").select("file", "block", (F.col("base") + F.col("block") - F.col("low")).alias("shift"))
        lines = raw.join(places, ["file", "block"]).select("value", (F.col("id") + F.col("shift")).alias("at")).where(F.length(F.trim(F.regexp_replace("value", r"\s", " "))) > 0)
        kinds = {}
        for topic in self.topics:
            kinds[topic] = parse_tagged(F.col("value"), topic.payload) if self.tagged else parse(F.col("value"), topic.payload)
        if self.tagged:
            known = F.lit(False)
            for topic, payload in kinds.items():
                known = known | ((type_id(F.col("value")) == topic.payload.type_id) & payload.isNotNull())
            broken = ~F.coalesce(known, F.lit(False))
        else:
            (only,) = kinds.values()
            broken = only.isNull()
        late = F.lit(False)
        for topic, payload in kinds.items():
            keys = self.topics[topic]
            mine = payload[topic.payload.key].isin(*keys) if keys is not None else F.lit(True)
            late = late | F.coalesce(mine & (payload[topic.payload.time] > z), F.lit(False))
        first = lines.agg(F.min(F.when(broken, F.col("at"))).alias("broken"), F.min(F.when(late, F.col("at"))).alias("late")).first()
        stop = min((x for x in first if x is not None), default=None)
        kept = lines if stop is None else lines.where(F.col("at") < F.lit(stop))
        frames = {}
        for topic, payload in kinds.items():
            rows = kept.withColumn("p", payload).where("p is not null")
            frames[topic.name] = in_window(self._envelope(rows, topic, F.col("p"), F.col("at")), a, None)
        # A broken line behind the reader's own stop is never met.
        failed = first.broken is not None and (first.late is None or first.broken < first.late)
        return Read(frames, f"broken line in {self.path}" if failed else None)

    def stream(self, spark: SparkSession, start: int, end: int) -> list[DataFrame]:
        from eventweave.streaming.live import live_jsonl

        return [live_jsonl(spark, topic, self.path, keys, tagged=self.tagged) for topic, keys in self.topics.items()]


@dataclass
class HeartbeatSource(Source):
    """Beats of one key at first, first + period, ... up to the end, both included."""

    key: str = "BEAT"
    period_ms: int = 1000
    first: int = 0
    end: int | None = None

    def __post_init__(self) -> None:
        if self.period_ms <= 0:
            raise ValueError("the period must be above 0")

    def read(self, spark: SparkSession, start: int, end: int) -> Read:
        (topic,) = self.topics
        beats = spark.range(self.first, (end if self.end is None else self.end) + 1, self.period_ms)
        struct = F.struct(F.lit(self.key).alias(HEART_BEAT.key), F.col("id").alias(HEART_BEAT.time))
        return Read({topic.name: self._envelope(beats, topic, struct, F.col("id"))})

    def stream(self, spark: SparkSession, start: int, end: int) -> list[DataFrame]:
        from eventweave.streaming.live import live_heartbeats

        (topic,) = self.topics
        return [live_heartbeats(spark, topic, self.key, self.period_ms, self.first, end if self.end is None else self.end)]


@dataclass
class IterableSource(Source):
    """Events of a Python iterable of (topic name, payload dict), in the order yielded.

    A topic it doesn't declare, a payload without its required fields or an exception ends the source; what came before stays. The
    iterable is run once, in one task, and written as it comes, a chunk at a time: neither the driver nor the task holds it whole. If
    that task is lost, the iterable is run again, so it should yield the same each time.
    """

    produce: Callable[[], Iterable[tuple[str, dict[str, Any]]]] = tuple
    chunk: int = 10_000

    def read(self, spark: SparkSession, start: int, end: int) -> Read:
        kinds, produce, chunk = {t.name: t.payload for t in self.topics}, self.produce, self.chunk
        columns = ["seq", "topic", "json", "failure"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for _ in batches:
                rows: list[tuple] = []
                try:
                    for i, (name, payload) in enumerate(produce()):
                        if name not in kinds:
                            raise KeyError(f"unknown topic {name!r}")
                        check_payload(kinds[name], payload)
                        rows.append((i, name, json.dumps(payload, default=str), None))
                        if len(rows) >= chunk:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                except Exception as x:  # noqa: BLE001
                    rows.append((None, None, None, f"{type(x).__name__}: {x}"))
                yield pd.DataFrame(rows, columns=columns).astype({"seq": "Int64"})

        made = materialise(spark.range(0, 1, 1, 1).mapInPandas(run, "seq bigint, topic string, json string, failure string"), "iterable")
        lost = made.where("failure is not null").select("failure").first()
        frames = {}
        for topic in self.topics:
            rows = made.where(F.col("topic") == topic.name).select("seq", parse(F.col("json"), topic.payload).alias("payload"))
            frames[topic.name] = self._envelope(rows.where("payload is not null"), topic, F.col("payload"), F.col("seq"))
        return Read(frames, None if lost is None else lost.failure)
