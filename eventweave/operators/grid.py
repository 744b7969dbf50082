"""Irregular readings to a regular grid by shape-preserving (monotone) piecewise cubic interpolation.

Series are cut into time shards so that no task holds a whole source. The outermost readings of each shard go to its neighbours (one
back, two ahead), which is all that the cubic's slopes at a shard's edge depend on; results don't depend on the shard length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DAY_MS = 86_400_000


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _inner_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """Weighted harmonic mean of the secants on both sides; 0 where they differ in sign, so that no new extremes arise."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 > 0, (w0 + w1) / (w0 / d0 + w1 / d1)).otherwise(0.0)


def _end_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """One-sided three-point slope at the end of the interval with secant d0, held to the data's shape."""
    d = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(F.signum(d) != F.signum(d0), 0.0).when((F.signum(d0) != F.signum(d1)) & (F.abs(d) > 3 * F.abs(d0)), 3 * d0).otherwise(d)


def regular_grid(
    readings: DataFrame, periods: DataFrame, *, source: str, at_ms: str, value: str, period_s: str = "period_s",
    max_gap_slots: int = 12, span: str = "day", shard_ms: int = DAY_MS, shard_rows: int = 1_000_000,
) -> DataFrame:
    """One row per slot: (source, slot_ms, value DOUBLE, state), state being "reading", "filled" or "gap".

    ``readings`` has source, epoch ms and value; rows in which any of them is null are no readings. ``periods`` has one row per
    source with its slot length in seconds; sources without a length, or with one under 1, give no rows. A slot with readings has the
    value of the last one (of readings at the same ms, the largest value). A slot between readings is interpolated at its first ms;
    where the two readings around it are more than ``max_gap_slots`` slots apart it stays null and is marked "gap", and no slope looks
    across. ``span`` "day" keeps the grid between the first and last slot with a reading of each UTC day, "series" between those of the
    whole series. Shards are ``shard_ms`` long, or shorter where one would have more than ``shard_rows`` readings: rows are counted first,
    so that no busy stretch of one source is a single task's. Empty input gives no rows; other columns are ignored.
    """
    lengths = periods.select(F.col(source).alias("s"), (F.col(period_s).cast("bigint") * 1000).alias("p")).where("s is not null and p > 0").groupBy("s").agg(F.max("p").alias("p"))
    timed = (
        readings.select(F.col(source).alias("s"), F.col(at_ms).cast("bigint").alias("x"), F.col(value).cast("double").alias("y"))
        .where("s is not null and x is not null and y is not null and not isnan(y)")
        .join(lengths, "s")
        .withColumn("slot", F.col("x") - F.pmod("x", "p"))
    )
    bucket = lambda ms: _div(F.col("x") - F.pmod(F.col("x"), F.lit(ms)), F.lit(ms).cast("bigint"))
    while shard_ms > 1000 and (timed.groupBy("s", bucket(shard_ms)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > shard_rows:
        shard_ms = max(1000, shard_ms // 16)
    base = (
        timed.withColumn("k", _div(F.col("slot") - F.pmod(F.col("slot"), F.lit(shard_ms)), F.lit(shard_ms).cast("bigint")))
        .repartition("s", "k")
        .groupBy("s", "k", "x").agg(F.max("y").alias("y"), F.max("slot").alias("slot"), F.max("p").alias("p"))
    )
    order = W.partitionBy("s", "k").orderBy("x")
    knots = base.withColumn("i", F.row_number().over(order))
    point = F.struct("x", "y")
    edges = knots.groupBy("s", "k").agg(
        F.max(F.when(F.col("i") == 1, point)).alias("a"), F.max(F.when(F.col("i") == 2, point)).alias("b"), F.max(F.struct("x", "y")).alias("z"),
        F.max(F.when(F.col("i") == 1, F.col("slot"))).alias("a_slot"),
    )
    along = W.partitionBy("s").orderBy("k")
    day = lambda c: _div(c - F.pmod(c, F.lit(DAY_MS)), F.lit(DAY_MS).cast("bigint"))
    halo = edges.select(
        "s", "k", F.lag("z").over(along).alias("h_prev"), F.lead("a").over(along).alias("h_next"), F.lead("a_slot").over(along).alias("h_next_slot"),
        F.coalesce(F.lead("b").over(along), F.lead("a", 2).over(along)).alias("h_next2"),
    )
    rows = knots.join(halo, ["s", "k"])
    prev, nxt, nxt2 = F.lag(point).over(order), F.lead(point).over(order), F.lead(point, 2).over(order)
    rows = rows.withColumns({
        "q0": F.coalesce(prev, "h_prev"), "q2": F.coalesce(nxt, "h_next"), "next_slot": F.coalesce(F.lead("slot").over(order), F.col("h_next_slot")),
        "q3": F.when(nxt.isNull(), F.col("h_next2")).otherwise(F.coalesce(nxt2, "h_next")),
    })
    # Whether the grid goes on to the next reading: with a span of days, if that is of the same day.
    rows = rows.withColumn("inside", F.col("next_slot").isNotNull() & (day(F.col("next_slot")) == day(F.col("slot")) if span == "day" else F.lit(True)))
    far = lambda a, b: (b - a) > F.col("p") * max_gap_slots
    x1, y1, x2, y2 = F.col("x"), F.col("y"), F.col("q2.x"), F.col("q2.y")
    h = (x2 - x1).cast("double")
    d = (y2 - y1) / h
    before, after = F.col("q0").isNotNull() & ~far(F.col("q0.x"), x1), F.col("q3").isNotNull() & ~far(x2, F.col("q3.x"))
    hb, db = (x1 - F.col("q0.x")).cast("double"), (y1 - F.col("q0.y")) / (x1 - F.col("q0.x")).cast("double")
    ha, da = (F.col("q3.x") - x2).cast("double"), (F.col("q3.y") - y2) / (F.col("q3.x") - x2).cast("double")
    left = F.when(before, _inner_slope(hb, h, db, d)).when(after, _end_slope(h, ha, d, da)).otherwise(d)
    right = F.when(after, _inner_slope(h, ha, d, da)).when(before, _end_slope(h, hb, d, db)).otherwise(d)
    p = F.col("p")
    covered = F.col("inside") & (F.col("next_slot") - F.col("slot") > p)
    missing = F.when(covered, F.sequence(F.col("slot") + p, F.col("next_slot") - p, p))
    own = F.when(F.col("next_slot").isNull() | (F.col("next_slot") != F.col("slot")), F.array("slot"))
    # Only rows that end their slot or start a stretch of empty ones go on; slopes are worked out for the latter alone.
    slots = rows.select(
        "s", "slot", "x", "y", "p", F.explode(F.concat(F.coalesce(own, F.array().cast("array<bigint>")), F.coalesce(missing, F.array().cast("array<bigint>")))).alias("g"),
        h.alias("h"), y2.alias("y2"), far(x1, x2).alias("wide"), F.when(covered, left).alias("m1"), F.when(covered, right).alias("m2"),
    )
    t = (F.col("g") - F.col("x")) / F.col("h")
    cubic = (
        F.col("y") * (1 + 2 * t) * (1 - t) * (1 - t) + F.col("h") * F.col("m1") * t * (1 - t) * (1 - t)
        + F.col("y2") * t * t * (3 - 2 * t) + F.col("h") * F.col("m2") * t * t * (t - 1)
    )
    is_reading = F.col("g") == F.col("slot")
    return slots.select(
        F.col("s").alias(source), F.col("g").alias("slot_ms"),
        F.when(is_reading, F.col("y")).when(~F.col("wide"), cubic).alias(value),
        F.when(is_reading, "reading").when(F.col("wide"), "gap").otherwise("filled").alias("state"),
    )
