"""Epoch counts of unstated unit, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventweave.functions.timeparse import LATEST_MS

#: The first instant whose counts can't be mixed up with another unit's: 1973-03-03 09:46:40 UTC.
UNMIXED_MS = 100_000_000_000


def epoch_ms(count: Column, earliest: int = UNMIXED_MS, latest: int = LATEST_MS) -> Column:
    """Epoch ms of a count in s, ms, us or ns, told apart by size; digits beyond ms are dropped.

    The four units can't be mixed up from 1973-03-03 on. A count that is no instant from ``earliest`` up to ``latest`` (excluded; the end
    of 2199) in any unit, or null, gives null.
    """
    c = count.cast("bigint")
    ms = (
        F.when(c < 100_000_000_000, c * 1000)
        .when(c < 100_000_000_000_000, c)
        .when(c < 100_000_000_000_000_000, F.call_function("div", c, F.lit(1000).cast("bigint")))
        .otherwise(F.call_function("div", c, F.lit(1_000_000).cast("bigint")))
    )
    return F.when((c > 0) & (ms >= earliest) & (ms < latest), ms)
