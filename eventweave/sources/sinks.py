"""Sinks. Each gets its deliveries as one frame in dispatch order: ord, topic, key, t, json; live, one such frame per batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from eventweave.session import materialise


@dataclass
class Sink:
    """``write`` takes a whole replay; ``write_batch`` a live batch, which may come again under its number after a failure.

    ``opened`` is called before the first batch of a live run, ``closed`` after its last, with the failure if it ends in one. ``errors``
    has what an isolating sink passed over: (actor, ord, t, kind, message), the actor being the sink.
    """

    name: str
    errors: DataFrame | None = field(default=None, init=False, repr=False)

    def write(self, deliveries: DataFrame) -> None:
        raise NotImplementedError

    def opened(self, spark: SparkSession) -> None: ...

    def write_batch(self, deliveries: DataFrame, batch: int) -> None:
        raise NotImplementedError

    def closed(self, spark: SparkSession, failure: Exception | None = None) -> None: ...


@dataclass
class JsonlSink(Sink):
    """One JSON payload per line in dispatch order; part files, read by name, keep that order. Overwrites, or appends.

    Live, each batch has a folder of its own under the path.
    """

    path: str = ""
    append: bool = False
    single_file: bool = False

    def _lines(self, deliveries: DataFrame) -> DataFrame:
        # What comes before runs in as many tasks as it likes; only the writing of one file is one task's.
        lines = deliveries.repartition(1).sortWithinPartitions("ord") if self.single_file else deliveries.sort("ord")
        return lines.select("json")

    def write(self, deliveries: DataFrame) -> None:
        self._lines(deliveries).write.mode("append" if self.append else "overwrite").text(self.path)

    def write_batch(self, deliveries: DataFrame, batch: int) -> None:
        self._lines(deliveries).write.mode("overwrite").text(f"{self.path}/batch={batch:09}")


@dataclass
class PrintSink(Sink):
    """Prints the first ``lines`` deliveries, of the run or of each live batch, as `topic <- payload`."""

    lines: int = 20
    show: Callable[[str], None] = print

    def write(self, deliveries: DataFrame) -> None:
        for r in deliveries.sort("ord").select("topic", "json").take(self.lines):
            self.show(f"{r.topic} <- {r.json}")

    def write_batch(self, deliveries: DataFrame, batch: int) -> None:
        self.write(deliveries)


@dataclass
class CallbackSink(Sink):
    """Calls a Python handler in one task: open, then process per delivery, then close; on an error close with it.

    Handlers see START, DATA in order, STOP and END as ``kind``; on an error END without STOP. A live batch has a handler of its own
    making: START reaches one before the first batch, STOP and END one after the last. With ``on_error`` "isolate" a failing delivery is
    passed over and noted in ``errors``.
    """

    handler: Callable[[], Callable[[str, str | None, str | None, int | None], None]] = field(default=lambda: lambda *a: None)
    on_error: str = "fail"

    def _calls(self, deliveries: DataFrame, before: tuple[str, ...], after: tuple[str, ...], last: str | None) -> None:
        make, isolate, name = self.handler, self.on_error == "isolate", self.name

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            handle = make()
            for kind in before:
                handle(kind, None, None, None)
            try:
                for pdf in batches:
                    lost = []
                    for ord_, topic, t, text in pdf.itertuples(index=False, name=None):
                        if ord_ is None:
                            continue
                        try:
                            handle("DATA", topic, text, int(t))
                        except Exception as x:
                            if not isolate:
                                raise
                            lost.append((name, ord_, int(t), "error", f"{type(x).__name__}: {x}"))
                    yield pd.DataFrame(lost, columns=["actor", "ord", "t", "kind", "message"])
                for kind in after:
                    handle(kind, None, None, None)
            finally:
                if last:
                    handle(last, None, None, None)

        # A row without a place keeps the task alive if there are no deliveries; it is passed over.
        mark = deliveries.sparkSession.range(1).selectExpr("cast(null as array<bigint>) ord", "'' topic", "0L t", "'' json")
        rows = deliveries.select("ord", "topic", "t", "json").unionByName(mark).repartition(1).sortWithinPartitions("ord")
        lost = materialise(rows.mapInPandas(run, "actor string, ord array<bigint>, t bigint, kind string, message string"), "sink")
        self.errors = lost if self.errors is None else self.errors.unionByName(lost)

    def _nothing(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], "ord array<bigint>, topic string, t bigint, json string")

    def write(self, deliveries: DataFrame) -> None:
        self._calls(deliveries, ("START",), ("STOP",), "END")

    def opened(self, spark: SparkSession) -> None:
        self._calls(self._nothing(spark), ("START",), (), None)

    def write_batch(self, deliveries: DataFrame, batch: int) -> None:
        self._calls(deliveries, (), (), None)

    def closed(self, spark: SparkSession, failure: Exception | None = None) -> None:
        self._calls(self._nothing(spark), () if failure else ("STOP",), (), "END")


@dataclass
class FrameSink(Sink):
    """Keeps the deliveries as a frame; live, those of the last batch (`LiveRun.deliveries` has them all)."""

    deliveries: DataFrame | None = None

    def write(self, deliveries: DataFrame) -> None:
        self.deliveries = deliveries

    def write_batch(self, deliveries: DataFrame, batch: int) -> None:
        self.deliveries = deliveries


@dataclass
class ParquetSink(Sink):
    """Parquet files; live, a folder per batch under the path."""

    path: str = ""

    def write(self, deliveries: DataFrame) -> None:
        deliveries.write.mode("overwrite").parquet(self.path)

    def write_batch(self, deliveries: DataFrame, batch: int) -> None:
        deliveries.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
