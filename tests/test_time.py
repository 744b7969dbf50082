"""Time texts: parsing, repeated and skipped local times, the dictionary, and nulls."""

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventweave.functions.epoch import epoch_ms
from eventweave.functions.timeparse import parse_text, to_utc
from eventweave.operators.timenorm import TimeDictionary, normalise

UTC = lambda *a: int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1000)


@pytest.mark.parametrize(
    ("text", "order", "want", "minutes", "zone"),
    [
        ("2024-09-20T00:10:05.685Z", "ymd", UTC(2024, 9, 20, 0, 10, 5, 685000), 0, None),
        (" 2024-09-20T02:08:28+02:00 ", "dmy", UTC(2024, 9, 20, 2, 8, 28), 120, None),
        ("20240919T200540-0530", "mdy", UTC(2024, 9, 19, 20, 5, 40), -330, None),
        ("2024-264T02:18:13+00:00", "dmy", UTC(2024, 9, 20, 2, 18, 13), 0, None),
        ("1/10/24 7:05 PM", "dmy", UTC(2024, 10, 1, 19, 5), None, None),
        ("1/10/24 7:05 PM", "mdy", UTC(2024, 1, 10, 19, 5), None, None),
        ("01-10-24 00:08", "dmy", UTC(2024, 10, 1, 0, 8), None, None),
        ("24/10/01 00:08", "ymd", UTC(2024, 10, 1, 0, 8), None, None),
        ("Wed, 30 Oct 2024 23:53:04 +1100", "dmy", UTC(2024, 10, 30, 23, 53, 4), 660, None),
        ("Nov 1, 2024 12:01 AM", "mdy", UTC(2024, 11, 1, 0, 1), None, None),
        ("1. Mär 2024, 02:06 Uhr", "dmy", UTC(2024, 3, 1, 2, 6), None, None),
        ("24 juil. 2024 10:00", "dmy", UTC(2024, 7, 24, 10), None, None),
        ("2024年10月1日 01:32", "ymd", UTC(2024, 10, 1, 1, 32), None, None),
        ("31-Okt-2024 22:27:00 GMT", "dmy", UTC(2024, 10, 31, 22, 27), 0, None),
        ("2024-09-19 19:22:05 America/Chicago", "mdy", UTC(2024, 9, 19, 19, 22, 5), None, "America/Chicago"),
        ("2024-09-19T21:39:20.807-04:00[America/New_York]", "mdy", UTC(2024, 9, 19, 21, 39, 20, 807000), -240, None),
        ("1708390437.5429", "mdy", 1708390437542, 0, None),
        ("1708393518809959", "mdy", 1708393518809, 0, None),
        ("1999-12-31T23:59:59Z", "ymd", UTC(1999, 12, 31, 23, 59, 59), 0, None),
        ("2016-12-31T23:59:60Z", "ymd", UTC(2017, 1, 1), 0, None),
        ("Wed, " + " " * 100_000 + "30 Oct 2024 " + " " * 100_000 + "23:53:04 +1100", "dmy", UTC(2024, 10, 30, 23, 53, 4), 660, None),
        ("2024-09-19T21:39:20.807123456-05:00[America/Argentina/ComodRivadavia_and_a_name_that_goes_on]", "mdy", UTC(2024, 9, 19, 21, 39, 20, 807000), -300, None),
    ],
)
def test_forms(text, order, want, minutes, zone):
    assert parse_text(text, order)[:3] == (want, minutes, zone)


@pytest.mark.parametrize("text", [None, "", "   ", "n/a", "0", "-", "99:99", "pending", "0000-00-00 00:00:00", "2024-13-01", "2024-02-30 10:00", "2024-01-01 25:00", "2024-367", "2024-01-01 10:00:61", "x" * 10_000, "2024-01-01 " + " " * 200_000 + "x", "12 Foo 2024"])
def test_no_times(text):
    assert parse_text(text, "dmy") is None


@settings(max_examples=200, deadline=None)
@given(st.integers(1_672_531_200, 2_800_000_000), st.sampled_from(["America/New_York", "Europe/Berlin", "Australia/Sydney", "Asia/Kolkata"]))
def test_zone_rules_agree_with_the_zone_database(sec, name):
    local = datetime.fromtimestamp(sec, timezone.utc).astimezone(ZoneInfo(name)).replace(tzinfo=None)
    ms = int((local - datetime(1970, 1, 1)).total_seconds()) * 1000
    first, last, shown = to_utc(np.array([ms]), name)
    assert shown[0] and sec * 1000 in (first[0], last[0])


def test_repeated_skipped_and_null_times(spark, tmp_path):
    rows = [
        (1, "2024-11-03 01:30:00", "America/New_York", UTC(2024, 11, 3, 6, 30)),
        (2, "2024-11-03 01:30:00", "America/New_York", UTC(2024, 11, 3, 5, 30)),
        (3, "2024-11-03 01:30:00", "America/New_York", None),
        (4, "2024-03-10 02:30:00", "America/New_York", None),
        (5, None, "America/New_York", None), (6, "", None, None), (7, "2024-05-05 10:00:00", None, None), (8, "2024-05-05 10:00:00", "No/Such", None),
        (9, "2024-05-05T10:00:00.123Z", None, None), (10, "2024-02-30T10:00:00.123Z", None, None), (11, "2024-05-05 10:00:00 UTC", None, None),
    ]
    # Names that clash with the operator's own.
    df = spark.createDataFrame(rows, "id bigint, raw string, zone string, ref bigint").withColumns({"kind": F.lit("x"), "norm_ms": F.lit(-1), "locale": F.lit("en_US"), "first_ms": F.lit(0)})
    times = TimeDictionary(spark, str(tmp_path / "d"))
    out = normalise(df, "raw", F.col("zone"), F.lit("en_US"), times, reference="ref")
    assert set(out.columns) == set(df.columns)
    got = {r.id: r.norm_ms for r in out.collect()}
    at = UTC(2024, 5, 5, 10)
    assert got == {1: UTC(2024, 11, 3, 6, 30), 2: UTC(2024, 11, 3, 5, 30), 3: UTC(2024, 11, 3, 5, 30), 4: None, 5: None, 6: None, 7: None, 8: None, 9: at + 123, 10: None, 11: at}


def test_dictionary_grows_only_by_what_is_new(spark, tmp_path):
    make = lambda *x: spark.createDataFrame([("instant", r, "UTC", None) for r in x], "kind string, raw string, zone string, locale string")
    times = TimeDictionary(spark, str(tmp_path / "d"))
    assert times.table().count() == 0
    times.add(make("2024-01-01 10:00", "2024-01-01 10:00", "n/a"))
    again = TimeDictionary(spark, str(tmp_path / "d"))
    again.add(make("2024-01-01 10:00", "2024-01-02 10:00"))
    again.add(make())
    assert sorted(r.raw for r in again.table().collect()) == ["2024-01-01 10:00", "2024-01-02 10:00", "n/a"]


def test_named_dictionary_is_taken_up_and_parses_nothing_twice(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"{1 + i % 28}/3/2024 10:00") for i in range(50)], "id int, raw string")
    at = str(tmp_path / "named")
    find = lambda: {r.id: r.norm_ms for r in normalise(df, "raw", F.lit("UTC"), F.lit("de"), TimeDictionary(spark, at)).collect()}
    first = find()
    files = lambda: sum(r.n for r in spark.read.parquet(at).selectExpr("count(*) n").collect())
    n = files()
    assert find() == first and files() == n == 28
    # An append that came twice doubles no row.
    spark.read.parquet(at).write.mode("append").parquet(at + "2")
    spark.read.parquet(at + "2").write.mode("append").parquet(at)
    assert files() == 56 and normalise(df, "raw", F.lit("UTC"), F.lit("de"), TimeDictionary(spark, at)).count() == 50
    named = TimeDictionary(spark, name="of-a-test")
    named.add(spark.createDataFrame([("instant", "2024-01-01 10:00", "UTC", None)], "kind string, raw string, zone string, locale string"))
    assert TimeDictionary(spark, name="of-a-test").table().count() == 1 and TimeDictionary(spark, name="of-a-test", span=(0, 1)).table().count() == 0


def test_span_of_instants(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["1999-05-05T10:00:00.000Z", "5 May 1999 10:00", "1899-05-05 10:00", "2150-05-05 10:00", "2250-01-01 00:00"])], "id int, raw string")
    find = lambda **kw: [r.norm_ms for r in normalise(df, "raw", F.lit("UTC"), F.lit("de"), TimeDictionary(spark, **kw)).sort("id").collect()]
    at = UTC(1999, 5, 5, 10)
    assert find() == [at, at, None, UTC(2150, 5, 5, 10), None] and find(span=(UTC(2000, 1, 1), UTC(2100, 1, 1))) == [None] * 5


def test_epoch_units(spark):
    at = 1_726_790_459_323
    df = spark.createDataFrame([(x,) for x in (at // 1000, at, at * 1000 + 7, at * 1_000_000 + 9, 0, -5, None, 12)], "c bigint")
    assert [r[0] for r in df.select(epoch_ms(F.col("c"))).collect()] == [at // 1000 * 1000, at, at, at, None, None, None, None]


def test_empty(spark):
    df = spark.createDataFrame([], "raw string, zone string")
    assert normalise(df, "raw", F.col("zone"), F.lit("C"), TimeDictionary(spark)).collect() == []
