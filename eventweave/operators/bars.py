"""What the bar operators share: feed homes, instants of bars, and shards of long series with halo rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from eventweave.functions.epoch import epoch_ms
from eventweave.operators.timenorm import TimeDictionary, normalise
from eventweave.session import materialise


def with_home(df: DataFrame, feeds: DataFrame) -> DataFrame:
    """Adds tz_name and locale_code of the row's feed (null for a null or unknown feed)."""
    homes = feeds.select(F.col("feed").alias("__feed"), "tz_name", "locale_code").dropDuplicates(["__feed"])
    return df.drop("tz_name", "locale_code").join(homes, F.col("feed") == F.col("__feed"), "left").drop("__feed")


def with_instant(bars: DataFrame, feeds: DataFrame, dictionary: TimeDictionary, out: str = "instant_ms") -> DataFrame:
    """Adds the bar's instant: its `timestamp`, or where that is null or no time, its `datetime` in the feed's home zone.

    Only rows without a timestamp go to the dictionary and its join; the others stay where they are. Keeps tz_name and locale_code.
    """
    homed = with_home(bars, feeds).withColumn("__ts", epoch_ms(F.col("timestamp")))
    counted = homed.where(F.col("__ts").isNotNull()).withColumn(out, F.col("__ts")).drop("__ts")
    written = normalise(homed.where(F.col("__ts").isNull()), "datetime", F.col("tz_name"), F.col("locale_code"), dictionary, out=out).drop("__ts")
    return counted.unionByName(written)


def with_shards(df: DataFrame, key: str, at_ms: str, *, rows: int, halo: int, bucket_ms: int) -> DataFrame:
    """Splits long series into consecutive shards of about ``rows`` rows and copies rows of neighbours in as halo.

    Adds __shard and __core (false on halo copies). A series of up to ``rows`` rows is one shard. For the longer ones, of which there are
    fewer than one per ``rows`` rows of input, a histogram of rows by (key, time bucket) gives each bucket's place in its series; a bucket
    belongs to the shard of its place, and is copied whole to each shard of which it holds some of the ``halo`` rows just before or
    after. A bucket that alone has more than ``rows`` rows is parted in 16 as often as it takes, down to a millisecond, so that every shard is
    one unbroken stretch, however skewed the keys or busy a moment, and no task gets more than about ``rows`` plus three buckets.
    The plans are written as tables of their own, so that Catalyst knows their size: they are broadcast under the threshold and joined
    by shuffle beyond. Rows with a null key or time are left out.
    """
    width = F.lit(bucket_ms).cast("bigint")
    bucketed = df.where(F.col(key).isNotNull() & F.col(at_ms).isNotNull()).withColumn("__bucket", F.col(at_ms) - F.pmod(F.col(at_ms), width))
    count = lambda d: d.groupBy(F.col(key).alias("__key"), F.col("__bucket").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    sizes = materialise(count(bucketed), "buckets")
    while (busy := sizes.where(F.col("__n") > rows)).limit(1).count() and bucket_ms > 1:
        # Only the busy buckets are parted.
        bucket_ms = max(1, bucket_ms // 16)
        heavy = materialise(busy.select(F.col("__key").alias("__k2"), F.col("__b").alias("__b2")), "busy")
        finer = F.col(at_ms) - F.pmod(F.col(at_ms), F.lit(bucket_ms).cast("bigint"))
        at = (F.col(key) == F.col("__k2")) & (F.col("__bucket") == F.col("__b2"))
        bucketed = bucketed.join(heavy, at, "left").withColumn("__bucket", F.when(F.col("__b2").isNotNull(), finer).otherwise(F.col("__bucket"))).drop("__k2", "__b2")
        sizes = materialise(count(bucketed), "buckets")
    order = W.partitionBy("__key").orderBy("__b")
    placed = sizes.withColumn("__all", F.sum("__n").over(W.partitionBy("__key"))).where(F.col("__all") > rows)
    placed = placed.withColumn("__to", F.sum("__n").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("__from", F.col("__to") - F.col("__n"))
    placed = placed.withColumn("__own", F.call_function("div", F.col("__from"), F.lit(rows).cast("bigint")))
    # Every bucket has a row at least, so that the nearest `halo` buckets hold the nearest `halo` rows.
    near = placed.withColumn("__prev", F.collect_set(F.struct("__own", "__to")).over(order.rowsBetween(-halo, -1)))
    near = near.withColumn("__next", F.collect_set(F.struct("__own", "__from")).over(order.rowsBetween(1, halo)))
    shards = F.array_union(
        F.array(F.col("__own")),
        F.array_union(
            F.transform(F.filter("__prev", lambda x: x["__to"] > F.col("__from") - halo), lambda x: x["__own"]),
            F.transform(F.filter("__next", lambda x: x["__from"] < F.col("__to") + halo), lambda x: x["__own"]),
        ),
    )
    plan = materialise(near.select("__key", "__b", "__own", F.array_distinct(shards).alias("__shards")), "shards")
    joined = bucketed.join(plan, (F.col(key) == F.col("__key")) & (F.col("__bucket") == F.col("__b")), "left")
    nought = F.lit(0).cast("bigint")
    spread = joined.withColumn("__shard", F.explode(F.coalesce("__shards", F.array(nought))))
    return spread.withColumn("__core", F.col("__shard") == F.coalesce("__own", nought)).drop("__key", "__b", "__bucket", "__own", "__shards")
