"""Queries of the time-series operators over the whole test tables, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweave.functions.epoch import epoch_ms
from eventweave.operators.bars import with_home, with_instant
from eventweave.operators.faults import find_faults
from eventweave.operators.grid import regular_grid
from eventweave.operators.rolling import trailing_totals
from eventweave.operators.timenorm import TimeDictionary, is_standard, normalise, resolve
from eventweave.session import table


def _time_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every written time of cdf_bars and messages_one as rows of (src_table, row_id, field_name, kind, raw, zone, locale, ref_ms)."""
    feeds = table(spark, sf_dir, "feeds")
    bars = with_home(table(spark, sf_dir, "cdf_bars").select("bar_id", "feed", "timestamp", "datetime", "date"), feeds)
    of_bars = bars.select(
        F.lit("cdf_bars").alias("src_table"), F.col("bar_id").alias("row_id"), F.col("tz_name").alias("zone"), F.col("locale_code").alias("locale"),
        epoch_ms(F.col("timestamp")).alias("ref_ms"),
        F.inline(F.array(
            F.struct(F.lit("datetime").alias("field_name"), F.lit("instant").alias("kind"), F.col("datetime").alias("raw")),
            F.struct(F.lit("date").alias("field_name"), F.lit("day").alias("kind"), F.col("date").alias("raw")),
        )),
    )
    messages = with_home(table(spark, sf_dir, "messages_one").select("msg_id", "feed", "msgTime"), feeds)
    of_messages = messages.select(
        F.lit("messages_one").alias("src_table"), F.col("msg_id").alias("row_id"), F.col("tz_name").alias("zone"), F.col("locale_code").alias("locale"),
        F.lit(None).cast("bigint").alias("ref_ms"), F.lit("msgTime").alias("field_name"), F.lit("instant").alias("kind"), F.col("msgTime").alias("raw"),
    )
    return of_bars.unionByName(of_messages)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value that names a time but not in the standard form, with its instant."""
    odd = _time_values(spark, sf_dir).where(F.col("raw").isNotNull() & ~F.when(F.col("kind") == "day", is_standard(F.col("raw"), "day")).otherwise(is_standard(F.col("raw"), "instant")))
    texts = resolve(odd, TimeDictionary(spark, name="all"), "ref_ms").where("norm_ms is not null").select("src_table", "row_id", "field_name", "norm_ms")
    counts = table(spark, sf_dir, "cdf_bars").select(
        F.lit("cdf_bars").alias("src_table"), F.col("bar_id").alias("row_id"), F.lit("timestamp").alias("field_name"), epoch_ms(F.col("timestamp")).alias("norm_ms"), "timestamp"
    )
    return texts.unionByName(counts.where("norm_ms is not null and norm_ms <> timestamp").drop("timestamp"))


def p1_bars_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar with its `timestamp`, `datetime` and `date` normalised (null where they name no time)."""
    times = TimeDictionary(spark, name="all")
    bars = with_home(table(spark, sf_dir, "cdf_bars").select("bar_id", "feed", "timestamp", "datetime", "date"), table(spark, sf_dir, "feeds"))
    bars = bars.withColumn("timestamp_ms", epoch_ms(F.col("timestamp")))
    bars = normalise(bars, "datetime", F.col("tz_name"), F.col("locale_code"), times, reference="timestamp_ms", out="datetime_ms")
    bars = normalise(bars, "date", F.col("tz_name"), F.col("locale_code"), times, kind="day", out="date_ms")
    return bars.select("bar_id", "timestamp_ms", "datetime_ms", "date_ms")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = table(spark, sf_dir, "cdf_bars").select("symb", epoch_ms(F.col("timestamp")).alias("at_ms"), "cl")
    return regular_grid(bars, table(spark, sf_dir, "instruments").select("symb", "period_s"), source="symb", at_ms="at_ms", value="cl")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots without a reading between the first and last slot with one of the same symb and UTC day."""
    return _grid(spark, sf_dir).where("state <> 'reading'").select("symb", "slot_ms")


def p2_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regular series: a row per slot with its close, read, interpolated or marked as a gap."""
    return _grid(spark, sf_dir).select("symb", "slot_ms", F.round("cl", 4).alias("cl"), "state")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of a faulty bar."""
    bars = table(spark, sf_dir, "cdf_bars").select("bar_id", "symb", "feed", "timestamp", "datetime", "op", "hi", "lo", "cl", "vwap")
    timed = with_instant(bars, table(spark, sf_dir, "feeds"), TimeDictionary(spark, name="bars"))
    return find_faults(timed, row_id="bar_id", source="symb", at_ms="instant_ms")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per bar: symb, calendar day, vlm and count. Rows of a symb at one instant are one bar; rows without an instant are each their own."""
    bars = table(spark, sf_dir, "cdf_bars").select("bar_id", "symb", "feed", "timestamp", "datetime", "date", "vlm", F.col("count").alias("n"))
    timed = with_instant(bars, table(spark, sf_dir, "feeds"), TimeDictionary(spark, name="bars"))
    # Days have a dictionary of their own: it holds one text per form and day, which stays small enough to broadcast.
    dated = normalise(timed, "date", F.col("tz_name"), F.col("locale_code"), TimeDictionary(spark, name="days"), kind="day", out="date_ms")
    # Days by arithmetic and timestamps without zone: the session's zone has no say.
    written = F.expr("date_add(DATE'1970-01-01', cast(date_ms div 86400000 as int))")
    clock = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(instant_ms as decimal(20, 0)) / 1000)")
    day = F.coalesce(written, F.to_date(F.convert_timezone(F.lit("UTC"), F.col("tz_name"), clock)))
    own = F.when(F.col("instant_ms").isNull(), F.col("bar_id"))
    return dated.select("symb", "instant_ms", own.alias("own"), written.alias("written"), day.alias("day"), "vlm", "n").groupBy("symb", "instant_ms", "own").agg(
        F.coalesce(F.min("written"), F.min("day")).alias("day"), F.max("vlm").alias("vlm"), F.max("n").alias("count")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of `vlm` and `count` over the 7 and 30 days that end on each day."""
    totals = trailing_totals(_daily(spark, sf_dir), entity="symb", day="day", amounts=["vlm", "count"], windows=[7, 30], averages=False)
    return totals.select("symb", F.date_format("day", "yyyy-MM-dd").alias("day_text"), "vlm_7d", "vlm_30d", "count_7d", "count_30d")


def p5_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of `vlm` and `count` over the same windows."""
    totals = trailing_totals(_daily(spark, sf_dir), entity="symb", day="day", amounts=["vlm", "count"], windows=[7, 30])
    return totals.select("symb", F.date_format("day", "yyyy-MM-dd").alias("day_text"), *[F.round(f"{a}_{n}d_avg", 6).alias(f"{a}_{n}d_avg") for a in ("vlm", "count") for n in (7, 30)])


QUERIES = {f.__name__: f for f in (p1_found, p1_bars_utc, p2_found, p2_regular, p3_found, p5_found, p5_averages)}

_MS = """CASE WHEN "timestamp" < 100000000000 THEN "timestamp" * 1000 WHEN "timestamp" < 100000000000000 THEN "timestamp"
        WHEN "timestamp" < 100000000000000000 THEN "timestamp" // 1000 ELSE "timestamp" // 1000000 END"""

#: The others parse texts of many forms or interpolate, which SQL can't say briefly; the tests hold them against brute force.
ORACLE = {
    "p2_found": f"""WITH r AS (SELECT symb, {_MS} - ({_MS}) % (period_s * 1000) AS slot, period_s * 1000 AS p FROM cdf_bars JOIN instruments USING (symb) WHERE "timestamp" IS NOT NULL AND cl IS NOT NULL),
        d AS (SELECT symb, any_value(p) AS p, min(slot) AS a, max(slot) AS z FROM r GROUP BY symb, slot // 86400000),
        g AS (SELECT symb, unnest(range(a, z + 1, p)) AS slot_ms FROM d)
        SELECT symb, CAST(slot_ms AS BIGINT) AS slot_ms FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.symb = g.symb AND r.slot = g.slot_ms)""",
    "p2_regular": f"""WITH b AS (SELECT symb, {_MS} AS x, CAST(cl AS DOUBLE) AS y, period_s * 1000 AS p FROM cdf_bars JOIN instruments USING (symb) WHERE "timestamp" IS NOT NULL AND cl IS NOT NULL),
        k AS (SELECT symb, x, max(y) AS y, any_value(p) AS p, x - x % any_value(p) AS slot FROM b GROUP BY symb, x),
        n AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(x, 2) OVER w AS x3, lead(y, 2) OVER w AS y3, lead(slot) OVER w AS s2 FROM k WINDOW w AS (PARTITION BY symb ORDER BY x)),
        d AS (SELECT *, coalesce(s2 // 86400000 = slot // 86400000, false) AS inside, x2 - x > 12 * p AS wide, CAST(x2 - x AS DOUBLE) AS h, (y2 - y) / (x2 - x) AS d1,
            CASE WHEN x - x0 <= 12 * p THEN CAST(x - x0 AS DOUBLE) END AS hb, (y - y0) / (x - x0) AS db, CASE WHEN x3 - x2 <= 12 * p THEN CAST(x3 - x2 AS DOUBLE) END AS ha, (y3 - y2) / (x3 - x2) AS da FROM n),
        e AS (SELECT *, ((2 * h + ha) * d1 - h * da) / (h + ha) AS el, ((2 * h + hb) * d1 - h * db) / (h + hb) AS er FROM d),
        m AS (SELECT *, CASE WHEN hb IS NOT NULL THEN CASE WHEN db * d1 > 0 THEN (3 * hb + 3 * h) / ((2 * h + hb) / db + (h + 2 * hb) / d1) ELSE 0 END
                WHEN ha IS NOT NULL THEN CASE WHEN sign(el) <> sign(d1) THEN 0 WHEN sign(d1) <> sign(da) AND abs(el) > 3 * abs(d1) THEN 3 * d1 ELSE el END ELSE d1 END AS m1,
            CASE WHEN ha IS NOT NULL THEN CASE WHEN d1 * da > 0 THEN (3 * h + 3 * ha) / ((2 * ha + h) / d1 + (ha + 2 * h) / da) ELSE 0 END
                WHEN hb IS NOT NULL THEN CASE WHEN sign(er) <> sign(d1) THEN 0 WHEN sign(d1) <> sign(db) AND abs(er) > 3 * abs(d1) THEN 3 * d1 ELSE er END ELSE d1 END AS m2 FROM e),
        g AS (SELECT *, unnest(range(slot + p, s2, p)) AS empty FROM m WHERE inside AND s2 - slot > p), f AS (SELECT *, (empty - x) / h AS t FROM g)
        SELECT symb, CAST(slot AS BIGINT) AS slot_ms, round(y, 4) AS cl, 'reading' AS state FROM n WHERE s2 IS NULL OR s2 <> slot
        UNION ALL SELECT symb, CAST(empty AS BIGINT), CASE WHEN NOT wide THEN round(y * (1 + 2 * t) * (1 - t) * (1 - t) + h * m1 * t * (1 - t) * (1 - t) + y2 * t * t * (3 - 2 * t) + h * m2 * t * t * (t - 1), 4) END,
            CASE WHEN wide THEN 'gap' ELSE 'filled' END FROM f""",
}
