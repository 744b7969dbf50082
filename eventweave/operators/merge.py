"""Deterministic merge of timed sources: windows, guards, the order key and dispatch positions.

An event's place in the total order is an array of integers, compared element by element:

    source event    [t, 0, rank, source index, place in its source ...]
    derived event   [t, 1, key of its trigger ..., target's place, ordinal of emission]

At one tick all source events come before derived ones, and those follow their triggers in order. The second element tells which shape
follows, so keys of different length never tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from eventweave.session import materialise


def in_window(df: DataFrame, start: int | None, end: int | None, t: str = "t") -> DataFrame:
    """Rows of start <= t <= end; None is no bound."""
    if start is not None:
        df = df.where(F.col(t) >= start)
    return df.where(F.col(t) <= end) if end is not None else df


def until_stop(df: DataFrame, seq: str, stop: Column) -> DataFrame:
    """Rows before the first one at which ``stop`` holds: one aggregate, whose single value comes to the driver; no ordering of the source."""
    first = df.where(stop).agg(F.min(seq)).first()[0]
    return df if first is None else df.where(F.col(seq) < F.lit(first))


#: Rows of the one table that `_max_before` orders in a task, at most, per row of the level above.
FAN = 10_000


def _max_before(tops: DataFrame, levels: int) -> DataFrame:
    """(c, before): for each chunk the largest m of all chunks below it, level by level, so that no task orders all chunks."""
    if not levels:
        return tops.select("c", F.max("m").over(W.orderBy("c").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    up = tops.withColumn("up", F.call_function("div", F.col("c"), F.lit(FAN).cast("bigint")))
    above = _max_before(up.groupBy(F.col("up").alias("c")).agg(F.max("m").alias("m")), levels - 1).select(F.col("c").alias("up"), F.col("before").alias("far"))
    near = F.max("m").over(W.partitionBy("up").orderBy("c").rowsBetween(W.unboundedPreceding, -1))
    return up.withColumn("near", near).join(above, "up").select("c", F.greatest("near", "far").alias("before"))


def monotonic_guard(df: DataFrame, seq: str, t: str = "t", chunk: int = 100_000) -> DataFrame:
    """Drops rows whose time lies before the latest time earlier in the source; equal times stay.

    A dropped row lies below the running maximum, so the maximum over all earlier rows is that over the accepted ones. It is taken per
    chunk of places, along the chunks, then within each chunk. Chunks are taken together FAN at a time, over as many levels as 64-bit
    places may need: no task orders more than a chunk or FAN rows, however sparse the places are.
    """
    step = F.call_function("div", F.col(seq), F.lit(chunk).cast("bigint"))
    parts = df.withColumn("__c", step)
    tops = parts.groupBy(F.col("__c").alias("c")).agg(F.max(t).alias("m"))
    before = _max_before(tops, 3).select(F.col("c").alias("__c"), F.col("before").alias("__b"))
    inner = F.max(t).over(W.partitionBy("__c").orderBy(seq).rowsBetween(W.unboundedPreceding, -1))
    held = parts.join(before, "__c").withColumn("__top", F.greatest(inner, F.col("__b")))
    return held.where(F.col("__top").isNull() | (F.col(t) >= F.col("__top"))).drop("__c", "__b", "__top")


def source_key(t: Column, rank: int, index: int, *seq: Column) -> Column:
    return F.array(t.cast("bigint"), F.lit(0).cast("bigint"), F.lit(rank).cast("bigint"), F.lit(index).cast("bigint"), *[s.cast("bigint") for s in seq])


def derived_key(t: Column, trigger: Column, target: Column, ordinal: Column) -> Column:
    return F.concat(F.array(t.cast("bigint"), F.lit(1).cast("bigint")), trigger, F.array(target.cast("bigint"), ordinal.cast("bigint")))


def with_position(df: DataFrame, order: str = "ord", out: str = "pos", by: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Numbers rows from 1 in the order of a column, over all rows or within each value of ``by``, without one task seeing a whole stream.

    One shuffle: range partitions are sorted and written once with each row's number in its partition, then counted, and the numbers
    are moved on by what the partitions before hold. So neither one long stream nor one hot value is a single task's. Rows that tie get
    their numbers in any order. Only what ``df`` has is written, so select first.
    """
    n, by = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by or []
    sorted_ = df.repartitionByRange(n, *by, order).sortWithinPartitions(*by, order)
    # The lower 33 bits of the id number the rows of a partition, in its order.
    ranged = materialise(sorted_.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranged")
    sizes = ranged.groupBy("__p", *by).agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__low"))
    along = (W.partitionBy(*by) if by else W).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("__n").over(along), F.lit(0)) - F.col("__low") + 1).alias("__shift")
    # A row per partition (and value), written so that its size is known: broadcast under the threshold.
    offsets = materialise(sizes.select(F.col("__p").alias("__q"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], shift), "offsets")
    on = F.col("__p") == F.col("__q")
    for i, c in enumerate(by):
        on = on & F.equal_null(F.col(c), F.col(f"__by{i}"))
    numbered = ranged.join(offsets, on).withColumn(out, F.col("__i") + F.col("__shift"))
    return numbered.drop("__p", "__q", "__i", "__shift", *[f"__by{i}" for i in range(len(by))])
