"""Trailing totals over calendar windows by event-contribution deltas.

Each day's amount is added on its day and taken away one window length later; the running sum of these deltas is the trailing total.
Rows are aggregated to (entity, day) before anything is ordered, so the ordered part has a few rows per entity and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from eventweave.session import materialise


def trailing_totals(daily: DataFrame, *, entity: str, day: str, amounts: list[str], windows: list[int], averages: bool = True) -> DataFrame:
    """One row per entity and day for every day that has rows itself or has some within the longest window before.

    ``daily`` may hold many rows per entity and day; null amounts count as 0, rows with a null entity or day are left out. Gives
    entity, day (DATE), and for each amount and window {amount}_{n}d BIGINT, with ``averages`` also {amount}_{n}d_avg DOUBLE (the total
    over the window's length in calendar days, idle days included). Empty input gives no rows; other columns are ignored.
    """
    longest = max(windows)
    sums = (
        daily.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(entity).alias("__e"), F.col(day).cast("date").alias("__d"))
        .agg(*[F.coalesce(F.sum(F.col(f"`{a}`").cast("bigint")), F.lit(0).cast("bigint")).alias(f"a{i}") for i, a in enumerate(amounts)])
    )
    # A row per entity and day, read thrice below: written once.
    sums = materialise(sums, "daily")
    order = W.partitionBy("__e").orderBy("__d")
    # The stretch of output days that a day with rows opens: up to the next such day, or until it leaves the longest window.
    until = F.least(F.date_add("__d", longest - 1), F.coalesce(F.date_sub(F.lead("__d").over(order), 1), F.date_add("__d", longest - 1)))
    opened = sums.withColumn("__until", until)
    days = opened.select("__e", F.explode(F.sequence("__d", "__until")).alias("__d"), F.lit(True).alias("shown"), *[F.lit(0).cast("bigint").alias(f"d{i}_{n}") for i in range(len(amounts)) for n in windows])
    shifts = F.array(*[F.lit(x) for x in [0, *windows]])
    deltas = sums.select("__e", "__d", F.explode(shifts).alias("__shift"), *[f"a{i}" for i in range(len(amounts))]).select(
        "__e", F.expr("date_add(__d, __shift)").alias("__d"), F.lit(False).alias("shown"),
        *[F.when(F.col("__shift") == 0, F.col(f"a{i}")).when(F.col("__shift") == n, -F.col(f"a{i}")).otherwise(F.lit(0).cast("bigint")).alias(f"d{i}_{n}") for i in range(len(amounts)) for n in windows],
    )
    events = days.unionByName(deltas).groupBy("__e", "__d").agg(F.max("shown").alias("shown"), *[F.sum(f"d{i}_{n}").alias(f"d{i}_{n}") for i in range(len(amounts)) for n in windows])
    running = order.rowsBetween(W.unboundedPreceding, 0)
    totals = {f"{a}_{n}d": F.sum(f"d{i}_{n}").over(running) for i, a in enumerate(amounts) for n in windows}
    out = events.select("__e", "__d", "shown", *[c.alias(k) for k, c in totals.items()]).where("shown")
    means = [(F.col(f"`{a}_{n}d`") / F.lit(float(n))).alias(f"{a}_{n}d_avg") for a in amounts for n in windows] if averages else []
    return out.select(F.col("__e").alias(entity), F.col("__d").alias(day), *[F.col(f"`{k}`") for k in totals], *means)
