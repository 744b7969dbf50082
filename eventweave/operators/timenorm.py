"""Mixed time texts to one UTC instant, through a dictionary of distinct texts.

Every distinct (kind, text, zone, locale) is parsed once, written to a Parquet dictionary that later runs only add to, and the
instants are joined back to the rows. Texts already in the standard form skip the dictionary: a cast gives their instant.

Typed epoch counts are told apart by size alone and don't come here (`functions.epoch`); those written as texts do.

Defined results: null, empty, blank and unreadable texts, impossible dates and clock times, unknown zones, instants outside the
dictionary's span (years 1900 to 2199, if not said otherwise), and local times that the clock skipped give a null instant. A local time shown twice gives the occurrence nearer to the
row's reference instant, the first where there is none. A null zone or one the zone database lacks gives null for texts that carry
no zone of their own. Columns of the input are kept, whatever their names; the result column replaces one of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweave.functions.timeparse import EARLIEST_MS, LATEST_MS, order_of, parse_text, to_utc
from eventweave.session import scratch_path, scratch_root

#: Standard forms by kind. An "instant" has zone Z and ms; a "day" is a plain ISO date.
STANDARD = {"instant": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$", "day": r"^\d{4}-\d{2}-\d{2}$"}
_KEYS = ["kind", "raw", "zone", "locale"]
_ENTRY = "kind string, raw string, zone string, locale string, first_ms bigint, last_ms bigint"


def is_standard(raw: Column, kind: str) -> Column:
    return raw.rlike(STANDARD[kind])


def standard_ms(raw: Column, kind: str, span: tuple[int, int] = (EARLIEST_MS, LATEST_MS)) -> Column:
    """Instant of a text in standard form; null for any other text, for impossible dates and instants outside ``span``."""
    written = raw if kind == "instant" else F.concat(raw, F.lit("T00:00:00.000Z"))
    ms = F.unix_millis(F.try_to_timestamp(written, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")))
    return F.when(is_standard(raw, kind) & (ms >= span[0]) & (ms < span[1]), ms)


def _parse(batches: Iterator[pd.DataFrame], span: tuple[int, int]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        n = len(pdf)
        first, last, good = np.zeros(n, "int64"), np.zeros(n, "int64"), np.zeros(n, bool)
        orders = {x: order_of(x) for x in pdf["locale"].unique()}
        local, zones = np.zeros(n, "int64"), {}
        for i, (kind, raw, zone, locale) in enumerate(pdf[_KEYS].itertuples(index=False, name=None)):
            got = parse_text(raw, orders[locale])
            if got is None:
                continue
            if kind == "day":
                first[i] = last[i] = got[0] - got[0] % 86_400_000
                good[i] = True
            elif got[1] is not None:
                first[i] = last[i] = got[0] - got[1] * 60_000
                good[i] = True
            elif got[2] or zone:
                local[i] = got[0]
                zones.setdefault(got[2] or zone, []).append(i)
        for name, at in zones.items():
            first[at], last[at], good[at] = to_utc(local[at], name)
        good &= (first >= span[0]) & (first < span[1])
        out = pdf[_KEYS].copy()
        out["first_ms"] = pd.array(np.where(good, first, 0), dtype="Int64")
        out["last_ms"] = pd.array(np.where(good, last, 0), dtype="Int64")
        out.loc[~good, ["first_ms", "last_ms"]] = pd.NA
        yield out


#: Raised when texts come to be read otherwise, so that no dictionary of before is taken up.
READING = 2


class TimeDictionary:
    """Distinct time texts and their instants, kept as Parquet files under ``path``; each ``add`` parses and appends only what is new.

    With a ``name`` instead of a path it lies in the cluster's shared scratch folder, where later runs find it and go on with it; with
    neither, in a folder of its own there. One writer at a time; should an append come twice all the same, its entries count once.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, name: str | None = None, span: tuple[int, int] = (EARLIEST_MS, LATEST_MS)) -> None:
        if path is None and name is not None:
            path = f"{scratch_root(spark)}/times-{name}-{READING}" + ("" if span == (EARLIEST_MS, LATEST_MS) else f"-{span[0]}-{span[1]}")
        self.spark, self.path, self.span = spark, path or scratch_path(spark, "times"), span
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        self._written = self._taken_up = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def table(self) -> DataFrame:
        if not self._written:
            return self.spark.createDataFrame([], _ENTRY)
        entries = self.spark.read.schema(_ENTRY).parquet(self.path)
        # Only what other runs have written may hold an entry twice.
        return entries.dropDuplicates(_KEYS) if self._taken_up else entries

    def add(self, texts: DataFrame) -> None:
        """``texts`` has kind, raw, zone and locale; rows may repeat, nulls in raw are left out. Parses what the dictionary lacks."""
        new, span = texts.select(*_KEYS).where(F.col("raw").isNotNull()).distinct(), self.span
        if self._written:
            old = self.spark.read.schema(_ENTRY).parquet(self.path).select(*_KEYS)
            new = new.join(old, [F.equal_null(new[k], old[k]) if k in ("zone", "locale") else new[k] == old[k] for k in _KEYS], "left_anti")
        new.mapInPandas(lambda batches: _parse(batches, span), _ENTRY).write.mode("append").parquet(self.path)
        self._written = True


def resolve(values: DataFrame, dictionary: TimeDictionary, reference: str | None = None, out: str = "norm_ms") -> DataFrame:
    """Adds ``out`` to rows with kind, raw, zone and locale. ``reference`` names a column of epoch ms that settles repeated local times.

    Dictionary keys are joined by Catalyst's choice: broadcast while the dictionary's files are under the broadcast threshold, else a
    sort-merge join whose hot keys the adaptive skew join splits. Null texts get spread keys that match nothing.
    """
    raw = F.col("raw")
    canonical = F.when(F.col("kind") == "day", standard_ms(raw, "day", dictionary.span)).otherwise(standard_ms(raw, "instant", dictionary.span))
    todo = ~F.when(F.col("kind") == "day", is_standard(raw, "day")).otherwise(is_standard(raw, "instant"))
    dictionary.add(values.where(todo))
    entries = dictionary.table().select(
        F.col("kind").alias("__kind"), F.col("raw").alias("__raw"), F.coalesce("zone", F.lit("")).alias("__zone"),
        F.coalesce("locale", F.lit("")).alias("__locale"), "first_ms", "last_ms",
    ).where(F.col("first_ms").isNotNull()).withColumnsRenamed({"first_ms": "__first", "last_ms": "__last"})
    plain = [F.col(f"`{c}`") for c, t in values.dtypes if "map<" not in t and "variant" not in t]
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*plain), F.lit(4096)).cast("string"))
    keyed = values.withColumns({"__key": F.coalesce(raw, spread), "__z": F.coalesce("zone", F.lit("")), "__l": F.coalesce("locale", F.lit(""))})
    joined = keyed.join(
        entries,
        (keyed["__key"] == entries["__raw"]) & (keyed["kind"] == entries["__kind"]) & (keyed["__z"] == entries["__zone"]) & (keyed["__l"] == entries["__locale"]),
        "left",
    )
    found = F.col("__first")
    if reference:
        ref = F.col(f"`{reference}`")
        found = F.when(F.abs(ref - F.col("__last")) < F.abs(ref - F.col("__first")), F.col("__last")).otherwise(found)
    return joined.withColumn(out, F.coalesce(canonical, found)).drop("__key", "__z", "__l", "__kind", "__raw", "__zone", "__locale", "__first", "__last")


def normalise(
    df: DataFrame, column: str, zone: Column, locale: Column, dictionary: TimeDictionary, *,
    kind: str = "instant", reference: str | None = None, out: str = "norm_ms",
) -> DataFrame:
    """Adds the instant (epoch ms) of one text column to a frame of any columns; see the module's notes for defined results.

    The frame's own columns travel in one struct, so that none of their names can clash.
    """
    packed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.lit(kind).alias("kind"), F.col(f"`{column}`").alias("raw"),
        zone.alias("zone"), locale.alias("locale"), (F.col(f"`{reference}`") if reference else F.lit(None).cast("bigint")).alias("__ref"),
    )
    done = resolve(packed, dictionary, "__ref", "__norm")
    kept = [F.col("__row").getField(c).alias(c) for c in df.columns if c != out]
    return done.select(*kept, F.col("__norm").alias(out))
