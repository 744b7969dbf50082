"""Each registered query of the core against its SQL, over the smallest tables; bars against brute force."""

import os
from pathlib import Path

import pandas as pd
import pytest

from eventweave.functions.timeparse import order_of, parse_text
from eventweave.plans import replay_queries, series_queries

SF = os.environ.get("EVENTWEAVE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
duckdb = pytest.importorskip("duckdb")
SQL = {**replay_queries.ORACLE, **series_queries.ORACLE}
ALL = {**replay_queries.QUERIES, **series_queries.QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, tmp_path, name):
    df = ALL[name](spark, SF)
    df.write.parquet(str(tmp_path / "out"))
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    con.sql(f"CREATE OR REPLACE TABLE got AS SELECT {cols} FROM '{tmp_path}/out/*.parquet'")
    con.sql(f"CREATE OR REPLACE TABLE want AS SELECT {cols} FROM ({SQL[name]})")
    for a, b in (("got", "want"), ("want", "got")):
        assert not con.sql(f"FROM {a} EXCEPT ALL FROM {b}").df().values.tolist()[:3]


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_others_run(spark, name):
    df = ALL[name](spark, SF)
    assert df.count() > 0


def test_every_time_of_the_bars_agrees_with_its_count(spark, con):
    rows = con.sql("SELECT bar_id, \"timestamp\" AS t, \"datetime\" AS d, locale_code FROM cdf_bars LEFT JOIN feeds USING (feed)").df()
    got = {r.row_id: r.norm_ms for r in series_queries.p1_found(spark, SF).where("field_name = 'datetime'").collect()}
    checked = 0
    for r in rows.itertuples():
        if r.bar_id in got and not pd.isna(r.t):
            t, precision = int(r.t), parse_text(r.d, order_of(r.locale_code))[3]
            while t > 4_102_444_800_000:
                t //= 1000
            t = t * 1000 if t < 100_000_000_000 else t
            assert 0 <= t - got[r.bar_id] < max(precision, 1000)
            checked += 1
    assert checked > 100


def test_found_has_no_row_twice(spark):
    for name in ("p1_found", "p2_found", "p3_found", "p5_found"):
        df = ALL[name](spark, SF)
        assert df.count() == df.distinct().count()
