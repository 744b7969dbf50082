"""The registered training-data queries over the smallest tables."""

import os
from pathlib import Path

import pytest

from eventweave.llm import queries

SF = os.environ.get("EVENTWEAVE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs_and_has_no_row_twice(spark, name):
    rows = [tuple(r) for r in queries.QUERIES[name](spark, SF).collect()]
    assert len(rows) == len(set(rows))
    assert rows or name.startswith(("p6", "p8_found"))


def test_rank_check_holds(spark):
    assert queries.p4_rank_check(spark, SF).where("percentile is null").count() == 0
