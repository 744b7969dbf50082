"""Implausible values in price bars by a hidden Markov model per source.

States are normal, spike, stuck and out-of-range. Emissions measure a bar against the middle of its neighbours in units of its source's
usual bar-to-bar move. How widely a source's bars spread, how often they repeat without fault, and how often it spikes, sticks and leaves
its range are estimated for each source from counts and quantiles that merge over shards. Forward-backward probabilities then assign the
states: a bar is flagged only if its fault's state is the likelier one, and within hard bounds on runs, levels and range. What is normal
for a restless or a sleepy source is so not flagged, though the bounds alone would. Series are cut into shards with halo rows (see
`bars.with_shards`), so that no task holds a whole source.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from eventweave.operators.bars import with_shards
from eventweave.session import materialise

NORMAL, SPIKE, STUCK, OUT = range(4)
PRICES = ["hi", "lo", "cl", "vwap"]
BLOCK = 64


#: Quantiles of |change of close| kept per source; the first is the usual move, the third tells the spread, all the share of great moves.
SHARES = [0.5, 0.9, 0.95, 0.97, 0.98, 0.985, 0.99, 0.995, 0.998, 0.999]
#: The 95 % quantile of |x| over its median, for a normal x.
NORMAL_RATIO = 2.906
#: What is known of a source, in the order in which it travels, and what holds where nothing is.
FACTS = ["scale", "sigma", "repeats", "spikes", "sticks", "stays", "leaves"]
UNKNOWN = {"scale": 0.0, "sigma": 2.0, "repeats": 0.01, "spikes": 0.005, "sticks": 0.002, "stays": 0.9, "leaves": 0.004}


@dataclass(frozen=True)
class FaultModel:
    """Parameters of the model. Spikes lie more than ``spike_moves`` usual moves off; stuck runs have ``stuck_bars`` bars or more."""

    spike_moves: float = 13.0
    spike_bars: int = 2
    stuck_bars: int = 6
    reach: int = 4  # bars on each side that make a bar's surroundings
    spread: float = 2.0  # standard deviation of a normal bar's distance, in usual moves, where moves are normal; wider tails widen it
    widest: float = 4.0  # how much at most
    prior: float = 200.0  # bars that the model's own rates count for beside those of the source
    shard_rows: int = 20_000
    halo_rows: int = 64
    bucket_ms: int = 86_400_000

    def transitions(self, facts: np.ndarray) -> np.ndarray:
        """A matrix per row of ``facts`` (in the order of FACTS): rates of entering a state from the source, of leaving spikes from the model."""
        spikes, sticks, stays, leaves = facts[:, 3], facts[:, 4], facts[:, 5], facts[:, 6]
        a = np.empty((len(facts), 4, 4))
        a[:, NORMAL] = np.stack([1 - spikes - sticks - leaves, spikes, sticks, leaves], 1)
        a[:, SPIKE] = [0.55, 0.42, 0.02, 0.01]
        a[:, STUCK] = np.stack([1 - stays, 0.1 * (1 - stays), stays, 0.1 * (1 - stays)], 1)
        a[:, OUT] = [0.90, 0.02, 0.02, 0.06]
        return a / a.sum(2, keepdims=True)


def forward_backward(log_emit: np.ndarray, starts: np.ndarray, trans: np.ndarray, other: np.ndarray | None = None, at_other: np.ndarray | None = None) -> np.ndarray:
    """Posterior state probabilities of many chains laid end to end; ``starts`` marks each chain's first row, ``trans`` has a matrix per chain,
    which leads to each row, or that of ``other`` to the rows marked by ``at_other``.

    Exact: blocks of rows are multiplied into transfer matrices side by side, block borders are solved one after another, and the
    blocks are then filled in side by side. A chain's start is a transition that forgets the state before it.
    """
    n, k = log_emit.shape
    m = -(-n // BLOCK)
    emit = np.ones((m * BLOCK, k))
    emit[:n] = np.exp(log_emit - log_emit.max(1, keepdims=True))
    first, chain = np.zeros(m * BLOCK, bool), np.zeros(m * BLOCK, int)
    first[:n], chain[:n] = starts, np.cumsum(starts) - 1
    begin = np.repeat(np.linalg.matrix_power(trans, 256)[:, :1], k, axis=1)
    both = np.concatenate([trans, begin, trans if other is None else other])
    kind = first.astype(int)
    if at_other is not None:
        kind[:n] = np.where(at_other & ~first[:n], 2, kind[:n])
    emit, which = emit.reshape(m, BLOCK, k), (chain + len(trans) * kind).reshape(m, BLOCK)
    step = lambda j: both[which[:, j]]
    whole = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    for j in range(BLOCK):
        whole = np.einsum("mab,mbc->mac", whole, step(j)) * emit[:, j, None, :]
        whole /= whole.sum((1, 2), keepdims=True)
    into, out = np.empty((m, k)), np.empty((m, k))
    a, b = np.full(k, 1.0 / k), np.full(k, 1.0 / k)
    for i in range(m):
        into[i] = a
        a = a @ whole[i]
        a /= a.sum()
    for i in reversed(range(m)):
        out[i] = b
        b = whole[i] @ b
        b /= b.sum()
    alpha, beta = np.empty((m, BLOCK, k)), np.empty((m, BLOCK, k))
    a, b = into, out
    for j in range(BLOCK):
        a = np.einsum("ma,mab->mb", a, step(j)) * emit[:, j]
        a /= a.sum(1, keepdims=True)
        alpha[:, j] = a
    for j in reversed(range(BLOCK)):
        beta[:, j] = b
        b = np.einsum("mab,mb->ma", step(j), emit[:, j] * b)
        b /= b.sum(1, keepdims=True)
    post = (alpha * beta).reshape(-1, k)[:n]
    return post / post.sum(1, keepdims=True)


def _nearest(good: np.ndarray, chain: np.ndarray, back: bool) -> np.ndarray:
    """Index of the nearest good row strictly before (``back``) or after each row in its chain, -1 where there is none."""
    n = len(good)
    if not back:
        r = _nearest(good[::-1], chain[::-1], True)[::-1]
        return np.where(r < 0, -1, n - 1 - r)
    at = np.maximum.accumulate(np.where(good, np.arange(n), -1))
    at = np.concatenate([[-1], at[:-1]])
    return np.where((at >= 0) & (chain[np.maximum(at, 0)] == chain), at, -1)


def _runs(same: np.ndarray) -> np.ndarray:
    """Length of the run each row is in, where ``same`` tells that a row equals the one before."""
    ids = np.cumsum(~same) - 1
    return np.bincount(ids)[ids]


def flag_chains(chain: np.ndarray, price: np.ndarray, bad: np.ndarray, facts: np.ndarray, model: FaultModel) -> np.ndarray:
    """Fault code (0 none, 1 stuck, 2 spike) of bars in order; ``chain`` numbers the series, ``price`` has hi, lo, cl and vwap.

    ``facts`` has a row per series, as FACTS say. ``bad`` marks out-of-range bars. Null prices are NaN: they equal nothing and deviate
    from nothing.
    """
    n = len(chain)
    if not n:
        return np.zeros(0, int)
    hi, lo, cl = price[:, 0], price[:, 1], price[:, 2]
    starts = np.concatenate([[True], chain[1:] != chain[:-1]])
    same = np.concatenate([[False], (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1]) & (cl[1:] == cl[:-1])]) & ~starts
    level = np.where(bad, np.nan, cl)
    near = np.full((n, 2 * model.reach + 1), np.nan)
    for j, d in enumerate(range(-model.reach, model.reach + 1)):
        a, b = max(0, -d), min(n, n - d)
        if a < b:
            near[a:b, j] = np.where(chain[a:b] == chain[a + d : b + d], level[a + d : b + d], np.nan)
    near.sort(axis=1)
    count = (~np.isnan(near)).sum(1)
    at = np.arange(n)
    centre = (near[at, np.maximum(count - 1, 0) // 2] + near[at, np.minimum(count // 2, 2 * model.reach)]) / 2
    of = np.cumsum(starts) - 1
    scale, sigma, repeats = facts[of, 0], facts[of, 1], np.log(facts[of, 2])
    unit = np.where(scale > 0, scale, np.nan)
    with np.errstate(invalid="ignore", divide="ignore"):
        off = np.abs(price - centre[:, None]) / unit[:, None]
        # A source whose usual move is nought: any other price is endlessly far.
        off = np.where(np.isnan(unit)[:, None] & (np.abs(price - centre[:, None]) > 0), 1e9, off)
        dev = np.nan_to_num(np.where(np.isnan(off), 0, off).max(1), posinf=1e9)
    frozen = same | np.concatenate([same[1:], [False]])
    usual = -np.minimum((dev / sigma) ** 2 / 2, 60.0)
    again = repeats * frozen
    emit = np.stack([usual + again, np.where(dev >= 0.6 * model.spike_moves, -6.0, -25.0) + again, np.where(frozen, 0.0, -40.0), np.full(n, -90.0)], 1)
    emit[bad] = [-90.0, -90.0, -90.0, 0.0]
    # To a bar that doesn't repeat the one before, one sticks anew if at all.
    trans = model.transitions(facts)
    anew = trans.copy()
    anew[:, STUCK] = trans[:, NORMAL]
    post = forward_backward(emit, starts, trans, anew, ~same)
    stuck = (post[:, STUCK] > 0.5) & (_runs(same) >= model.stuck_bars) & ~bad
    maybe = (post[:, SPIKE] > 0.5) & ~bad & ~stuck
    # Levels come from the nearest bars that are no candidates themselves; a stretch of candidates longer than a spike is a change of level.
    # Bars of such a stretch that are not clear of the levels around it are no part of it, but levels for the others.
    while True:
        steady = ~maybe & ~np.isnan(level)
        ids = np.cumsum(~maybe | starts | np.concatenate([[True], ~maybe[:-1]]))
        length = np.bincount(ids)[ids]
        before, after = _nearest(steady, chain, True), _nearest(steady, chain, False)
        lb, la = np.where(before >= 0, level[before], np.nan), np.where(after >= 0, level[after], np.nan)
        with np.errstate(invalid="ignore"):
            bound = model.spike_moves * scale[:, None]
            up, down = price - lb[:, None], price - la[:, None]
            clear = (((up > bound) & (down > bound)) | ((up < -bound) & (down < -bound))).any(1)
        loose = maybe & (length > model.spike_bars) & ~clear
        if not loose.any():
            break
        maybe = maybe & ~loose
    spike = maybe & (length <= model.spike_bars) & clear
    return np.where(stuck, 1, np.where(spike, 2, 0))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames in which each group of equal keys is whole, from sorted batches that may cut groups."""
    kept: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), bool)
        for k in keys:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        last = np.flatnonzero(change)
        new = bool(kept) and any(kept[-1][k].iloc[-1] != pdf[k].iloc[0] for k in keys)
        if len(last):
            yield pd.concat([*kept, pdf.iloc[: last[-1]]], ignore_index=True)
            kept = [pdf.iloc[last[-1] :]]
        elif new:
            yield pd.concat(kept, ignore_index=True)
            kept = [pdf]
        else:
            kept.append(pdf)
    if kept:
        yield pd.concat(kept, ignore_index=True)


def find_faults(bars: DataFrame, *, row_id: str, source: str, at_ms: str, model: FaultModel = FaultModel()) -> DataFrame:
    """(row_id, fault) of each row of a faulty bar, fault being "impossible", "stuck" or "spike".

    ``bars`` has op, hi, lo, cl and vwap besides the named columns. Rows of a source at the same instant are one bar, told by the row
    with the least row_id; all get its fault. Rows without a source or an instant are judged by hard bounds alone. Nulls break no bound,
    equal nothing and deviate from nothing. The usual move is the median of |change of cl| between successive bars, to a rank error of
    1e-4; where that is 0 it is the median of hi - lo, and where that is 0 too any deviation is a spike. A source's bars that repeat so
    often, or move so widely, that the model takes a run or a deviation for normal are not flagged; see `_facts`.
    Empty input gives no rows; other columns are ignored.
    """
    p = {c: F.col(c) for c in ["op", *PRICES]}
    wrong = F.lit(False)
    for c in p.values():
        wrong = wrong | F.coalesce(c <= 0, F.lit(False))
    for c in (p["op"], p["cl"], p["vwap"]):
        wrong = wrong | F.coalesce(c < p["lo"], F.lit(False)) | F.coalesce(c > p["hi"], F.lit(False))
    wrong = wrong | F.coalesce(p["lo"] > p["hi"], F.lit(False))
    # Read thrice below, so written once, as narrow as can be.
    rows = materialise(bars.select(
        F.col(row_id).alias("__id"), F.col(source).alias("__s"), F.col(at_ms).alias("__t"), wrong.alias("__bad"), *[p[c].cast("double").alias(f"__{c}") for c in PRICES]
    ), "bars")
    impossible = rows.where("__bad").select(F.col("__id").alias(row_id), F.lit("impossible").alias("fault"))
    shards = with_shards(rows, "__s", "__t", rows=model.shard_rows, halo=model.halo_rows, bucket_ms=model.bucket_ms)
    facts = _facts(shards, rows.where("__bad"), model)
    # Each shard's facts travel in front of its rows, as two rows of their own, so that no row need carry them.
    nought = F.lit(0.0)
    put = lambda i, *cols: facts.select(F.lit(None).cast(kind).alias("__id"), "__s", F.lit(FIRST + i).alias("__t"), F.lit(False).alias("__bad"), *[c.alias(f"__{x}") for c, x in zip(cols, PRICES)], "__shard", F.lit(False).alias("__core"))
    kind = dict(bars.dtypes)[row_id]
    ahead = put(0, *map(F.col, FACTS[:4])).unionByName(put(1, *map(F.col, FACTS[4:]), nought))

    def flags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["__s", "__shard"]):
            s, k, t = (pdf[c].to_numpy() for c in ("__s", "__shard", "__t"))
            group = np.cumsum(np.concatenate([[False], (s[1:] != s[:-1]) | (k[1:] != k[:-1])]))
            told = np.tile(np.array([UNKNOWN[f] for f in FACTS]), (group[-1] + 1, 1))
            price = pdf[[f"__{c}" for c in PRICES]].to_numpy("float64")
            for i, part in ((0, slice(0, 4)), (1, slice(4, 7))):
                at = np.flatnonzero(t == FIRST + i)
                told[group[at], part] = price[at, : part.stop - part.start]
            real = np.flatnonzero(t > FIRST + 1)
            if not len(real):
                continue
            group, t, price, bad, core = group[real], t[real], price[real], pdf["__bad"].to_numpy(bool)[real], pdf["__core"].to_numpy(bool)[real]
            seen, chain = np.unique(group, return_inverse=True)
            head = np.concatenate([[True], (chain[1:] != chain[:-1]) | (t[1:] != t[:-1])])
            one = np.flatnonzero(head)
            code = flag_chains(chain[one], price[one], bad[one], told[seen], model)[np.cumsum(head) - 1]
            hit = np.flatnonzero((code > 0) & core & ~bad)
            yield pd.DataFrame({row_id: pdf["__id"].iloc[real[hit]].array, "fault": np.where(code[hit] == 1, "stuck", "spike")})

    # Ids travel as text: pandas would make floats of integers beside the nulls of the rows ahead.
    every = shards.select(*ahead.columns).unionByName(ahead)
    sorted_rows = every.repartition("__s", "__shard").sortWithinPartitions("__s", "__shard", "__t", "__id").withColumn("__id", F.col("__id").cast("string"))
    found = sorted_rows.mapInPandas(flags, f"`{row_id}` string, fault string")
    return impossible.unionByName(found.select(F.col(f"`{row_id}`").cast(kind).alias(row_id), "fault"))


#: Time of the rows that carry a shard's facts, before any other.
FIRST = -(2**63)


def _facts(shards: DataFrame, bad: DataFrame, model: FaultModel) -> DataFrame:
    """(__s, __shard, FACTS): what is known of each source, for each of its shards. All of it merges: quantiles, and counts beside the model's own.

    The usual move is the median |change of close|, or where that is 0 the median of hi - lo. ``sigma`` is the model's spread, wider where
    the tail of the source's moves is. ``repeats`` is the share of bars that repeat the one before in runs too short to be stuck.
    """
    order = W.partitionBy("__s", "__shard").orderBy("__t", "__id")
    lag = lambda c: F.lag(c).over(order)
    same = (F.col("__hi") == lag("__hi")) & (F.col("__lo") == lag("__lo")) & (F.col("__cl") == lag("__cl"))
    moves = shards.where("not __bad and __cl is not null").select(
        "__s", "__shard", "__core", "__t", "__id", lag("__t").alias("__t0"), F.abs(F.col("__cl") - lag("__cl")).alias("__move"), (F.col("__hi") - F.col("__lo")).alias("__range"), F.coalesce(same, F.lit(False)).alias("__same")
    ).where("__t0 is null or __t > __t0")
    long = F.col("__same")
    for back in range(1, model.stuck_bars - 1):
        long = long & F.coalesce(F.lag("__same", back).over(order), F.lit(False))
    begun = long & ~F.coalesce(F.lag("__same", model.stuck_bars - 1).over(order), F.lit(False))
    counted = moves.withColumns({"__long": long, "__begun": begun}).where("__core and __t0 is not null")
    n_if = lambda c: F.count_if(c).cast("double")
    per = counted.groupBy("__s").agg(
        F.percentile_approx("__move", SHARES, 10_000).alias("q"), F.percentile_approx("__range", 0.5, 10_000).alias("r"), F.count(F.lit(1)).cast("double").alias("n"),
        n_if("__same").alias("same"), n_if("__long").alias("long"), n_if("__begun").alias("runs"), F.collect_set("__shard").alias("shards"),
    )
    out = bad.groupBy("__s").agg(F.count(F.lit(1)).cast("double").alias("out"))
    rate = lambda have, of, usual: (have + model.prior * usual) / (of + model.prior)
    m = F.element_at("q", 1)
    ratio = F.when(m > 0, F.element_at("q", 3) / m / NORMAL_RATIO).otherwise(1.0)
    calm = F.aggregate(F.arrays_zip(F.col("q"), F.array(*map(F.lit, SHARES)).alias("share")), F.lit(0.0), lambda a, x: F.when(x["q"] <= model.spike_moves * m, F.greatest(a, x["share"])).otherwise(a))
    in_long = F.col("long") + (model.stuck_bars - 2) * F.col("runs")
    known = per.join(out, "__s", "left").select(
        "__s", F.explode("shards").alias("__shard"), F.when(m > 0, m).otherwise(F.col("r")).alias("scale"),
        (model.spread * F.greatest(F.lit(1.0), F.least(F.lit(model.widest), ratio))).alias("sigma"),
        rate(F.greatest(F.col("same") - in_long, F.lit(0.0)), F.col("n"), UNKNOWN["repeats"]).alias("repeats"),
        # A spike makes two great moves.
        rate(F.when(m > 0, (1 - calm) / 2 * F.col("n")).otherwise(0.0), F.col("n"), UNKNOWN["spikes"]).alias("spikes"),
        rate(F.col("runs"), F.col("n"), UNKNOWN["sticks"]).alias("sticks"), ((in_long + 9) / (in_long + F.col("runs") + 10)).alias("stays"),
        rate(F.coalesce("out", F.lit(0.0)), F.col("n"), UNKNOWN["leaves"]).alias("leaves"),
    )
    return materialise(known, "facts")
