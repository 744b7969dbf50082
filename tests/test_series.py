"""Grid, faults, trailing totals and shards against brute force on small fixtures, with nulls, ties, repeats and clashing names."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventweave.operators import faults
from eventweave.operators.bars import with_shards
from eventweave.operators.faults import FACTS, UNKNOWN, FaultModel, find_faults, flag_chains, forward_backward
from eventweave.operators.grid import DAY_MS, regular_grid
from eventweave.operators.rolling import trailing_totals


def pchip(x, y, at):
    """Brute force: the usual monotone cubic of one segment."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    if len(x) == 2:
        m[:] = d[0]
    else:
        for k in range(1, len(x) - 1):
            if d[k - 1] * d[k] > 0:
                a, b = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
                m[k] = (a + b) / (a / d[k - 1] + b / d[k])

        def end(h0, h1, d0, d1):
            v = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            return 0.0 if np.sign(v) != np.sign(d0) else 3 * d0 if np.sign(d0) != np.sign(d1) and abs(v) > 3 * abs(d0) else v

        m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    i = np.searchsorted(x, at, "right") - 1
    t = (at - x[i]) / h[i]
    return y[i] * (1 + 2 * t) * (1 - t) ** 2 + h[i] * m[i] * t * (1 - t) ** 2 + y[i + 1] * t * t * (3 - 2 * t) + h[i] * m[i + 1] * t * t * (t - 1)


@pytest.mark.parametrize("shard_ms", [DAY_MS, 7_000, 60_000])
def test_grid_does_not_depend_on_shards(spark, shard_ms):
    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(0, 300_000, 90))
    x = x[(x < 120_000) | (x > 180_000)]
    y = rng.normal(size=len(x)).cumsum()
    rows = [("a", int(i), float(v)) for i, v in zip(x, y)]
    df = spark.createDataFrame(rows + rows[:5] + [("a", None, 1.0), ("a", 5, None), (None, 5, 1.0), ("b", 5, 2.0), ("zero", 5, 2.0)], "s string, t bigint, v double").withColumn("slot", F.lit(1)).withColumn("p", F.lit(2))
    periods = spark.createDataFrame([("a", 1), ("b", 1), ("zero", 0), ("c", 1), (None, 1)], "s string, period_s int")
    got = {(r.s, r.slot_ms): r for r in regular_grid(df, periods, source="s", at_ms="t", value="v", max_gap_slots=20, span="series", shard_ms=shard_ms).collect()}
    assert {k for k in got if k[0] == "b"} == {("b", 0)} and not any(k[0] == "zero" for k in got)
    slots = x // 1000 * 1000
    assert sorted(k[1] for k in got if k[0] == "a") == list(range(slots[0], slots[-1] + 1, 1000))
    cut = np.flatnonzero(np.diff(x) > 20_000)
    segments = np.split(np.arange(len(x)), cut + 1)
    for (s, slot), r in got.items():
        if s != "a":
            continue
        if slot in slots:
            assert r.state == "reading" and r.v == y[np.flatnonzero(slots == slot)[-1]]
            continue
        seg = next((g for g in segments if x[g[0]] < slot < x[g[-1]]), None)
        assert (r.state, r.v is None) == (("gap", True) if seg is None else ("filled", False))
        if seg is not None:
            assert r.v == pytest.approx(pchip(x[seg], y[seg], slot), abs=1e-9)


def test_grid_by_day_and_empty(spark):
    df = spark.createDataFrame([("a", DAY_MS - 5000, 1.0), ("a", DAY_MS + 3000, 2.0), ("a", DAY_MS + 6000, 3.0)], "s string, t bigint, v double")
    periods = spark.createDataFrame([("a", 1)], "s string, period_s int")
    grid = regular_grid(df, periods, source="s", at_ms="t", value="v")
    assert sorted(r.slot_ms - DAY_MS for r in grid.collect()) == [-5000, 3000, 4000, 5000, 6000]
    assert regular_grid(df.limit(0), periods, source="s", at_ms="t", value="v").collect() == []


def test_busy_shards_are_made_shorter_and_days_stay_apart(spark):
    rng = np.random.default_rng(12)
    x = np.unique(rng.integers(DAY_MS - 400_000, DAY_MS + 400_000, 500))
    df = spark.createDataFrame([("a", int(i), float(v)) for i, v in zip(x, rng.normal(size=len(x)))], "s string, t bigint, v double")
    periods = spark.createDataFrame([("a", 1)], "s string, period_s int")
    for span in ("day", "series"):
        one, few = (sorted(map(tuple, regular_grid(df, periods, source="s", at_ms="t", value="v", span=span, shard_rows=n).collect())) for n in (1_000_000, 40))
        assert [r[:2] + r[3:] for r in one] == [r[:2] + r[3:] for r in few] and np.allclose([r[2] for r in one if r[2] is not None], [r[2] for r in few if r[2] is not None])


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    emit, starts = rng.normal(size=(150, 4)) * 2, np.zeros(150, bool)
    starts[[0, 1, 70]] = True
    facts = np.tile([UNKNOWN[f] for f in FACTS], (3, 1))
    facts[1, 3:] = [0.1, 0.05, 0.6, 0.02]
    each = FaultModel().transitions(facts)
    assert np.allclose(each.sum(2), 1)
    got = forward_backward(emit, starts, each)
    for a, (lo, hi) in zip(each, ((0, 1), (1, 70), (70, 150))):
        pi = np.linalg.matrix_power(a, 200)[0]
        e = np.exp(emit[lo:hi])
        f, b = [pi * e[0]], [np.ones(4)]
        for i in range(1, hi - lo):
            f.append((f[-1] @ a) * e[i] / f[-1].sum())
        for i in range(hi - lo - 1, 0, -1):
            v = a @ (e[i] * b[0])
            b.insert(0, v / v.sum())
        want = np.array(f) * np.array(b)
        assert np.allclose(got[lo:hi], want / want.sum(1, keepdims=True), atol=1e-9)


def _known(scale, n=1):
    """Facts of n series with this usual move."""
    out = np.tile([UNKNOWN[f] for f in FACTS], (n, 1))
    out[:, 0] = scale
    return out


def _bars(n=400, seed=3):
    rng = np.random.default_rng(seed)
    cl = (100 + rng.normal(size=n).cumsum() * 0.2).tolist()
    return [[i, "a", i * 60_000, cl[i], cl[i] + 0.1, cl[i] - 0.1, cl[i], cl[i]] for i in range(n)]


def test_faults_and_shards(spark):
    rows = _bars()
    for i in (50, 51, 120):
        rows[i][4:8] = [v + 30 for v in rows[i][4:8]]
        rows[i][3] += 30
    for i in range(200, 207):
        rows[i][3:8] = rows[200][3:8]
    for i in range(260, 264):
        rows[i][3:8] = rows[260][3:8]
    for i in range(300, 400):
        rows[i][3:8] = [v + 40 for v in rows[i][3:8]]
    rows[330][5] = rows[330][4] + 1
    rows[340][6] = -1.0
    rows[350][3:8] = [None] * 5
    want = {50: "spike", 51: "spike", 120: "spike", 330: "impossible", 340: "impossible"} | {i: "stuck" for i in range(200, 207)}
    extra = [[1000, *rows[120][1:]], [1001, *rows[330][1:]], [1002, *rows[10][1:]], [1003, "a", None, 5.0, 4.0, 6.0, 5.0, 5.0], [1004, None, 60_000, 5.0, 6.0, 4.0, 5.0, 5.0], [1005, "one", 5, 5.0, 6.0, 4.0, 5.0, 5.0]]
    want |= {1000: "spike", 1001: "impossible", 1003: "impossible"}
    df = spark.createDataFrame(rows + extra, "bar_id bigint, symb string, t bigint, op double, hi double, lo double, cl double, vwap double").withColumn("fault", F.lit("x"))
    for model in (FaultModel(), FaultModel(shard_rows=50, halo_rows=20, bucket_ms=600_000)):
        got = find_faults(df, row_id="bar_id", source="symb", at_ms="t", model=model).collect()
        assert {r.bar_id: r.fault for r in got} == want and len(got) == len(want)
    assert find_faults(df.limit(0), row_id="bar_id", source="symb", at_ms="t").collect() == []


@pytest.mark.parametrize("spikes", [[21], [21, 22]])
@pytest.mark.parametrize("volatile", [[20], [23], [20, 23]])
def test_spikes_beside_a_volatile_bar(spikes, volatile):
    cl = 100 + np.tile([0.0, 1.0], 20)
    price = np.stack([cl + 0.5, cl - 0.5, cl, cl], 1)
    price[spikes, 1] -= 62
    price[[i if i < 21 else spikes[-1] + 1 for i in volatile], 0] = 100.5 + 8.4
    flags = flag_chains(np.zeros(40, int), price, np.zeros(40, bool), _known(1.0), FaultModel())
    assert np.flatnonzero(flags).tolist() == spikes
    # Three bars off are a change of level.
    price[20:23] = [161, 159, 160, 160]
    price[[20, 22], 0] += 0.25
    assert not flag_chains(np.zeros(40, int), price, np.zeros(40, bool), _known(1.0), FaultModel())[20:23].any()


def test_flags_of_flat_and_null_series():
    none = np.full((20, 4), np.nan)
    assert not flag_chains(np.zeros(20, int), none, np.zeros(20, bool), _known(0.0), FaultModel()).any()
    flat = np.ones((20, 4))
    assert (flag_chains(np.zeros(20, int), flat, np.zeros(20, bool), _known(0.0), FaultModel()) == 1).all()
    assert not flag_chains(np.arange(20), flat, np.zeros(20, bool), _known(0.0, 20), FaultModel()).any()
    assert len(flag_chains(np.zeros(0, int), np.zeros((0, 4)), np.zeros(0, bool), _known(1.0, 0), FaultModel())) == 0


def test_the_model_decides_what_is_usual_for_a_source(spark, monkeypatch):
    """Deviations and repeats that the bounds alone would flag are normal for a source that always has them."""
    n, rng = 600, np.random.default_rng(8)
    calm = 100 + rng.normal(size=n).cumsum() * 0.2
    restless = calm.copy()
    restless[5::7] += 15 * 0.2 * rng.choice([-1, 1], len(restless[5::7]))
    lengths = [x for _ in range(60) for x in (5, 4, 3, 2, 5, 3)]
    lengths[60] = 6
    sleepy = np.repeat(100 + rng.normal(size=len(lengths)).cumsum() * 0.2, lengths)[:n]
    calm[300] += 15
    calm[400:406] = calm[400]
    rows = []
    for k, cl in enumerate((calm, restless, sleepy)):
        rows += [(1000 * k + i, "crs"[k], i * 60_000, *[float(x) for x in (c, c + 0.1, c - 0.1, c, c)]) for i, c in enumerate(cl)]
    df = spark.createDataFrame(rows, "bar_id bigint, symb string, t bigint, op double, hi double, lo double, cl double, vwap double")
    find = lambda: {r.bar_id: r.fault for r in find_faults(df, row_id="bar_id", source="symb", at_ms="t").collect()}
    want = {300: "spike"} | {i: "stuck" for i in range(400, 406)}
    assert find() == want
    # With the posteriors taken away and the bounds left, the other two are flagged as well.
    price = np.stack([restless + 0.1, restless - 0.1, restless, restless], 1)
    facts = _known(float(np.median(np.abs(np.diff(restless)))))
    assert (flag_chains(np.zeros(n, int), price, np.zeros(n, bool), facts, FaultModel()) == 2).sum() > 20
    facts[0, 1] = 8.0
    assert (flag_chains(np.zeros(n, int), price, np.zeros(n, bool), facts, FaultModel()) == 2).sum() == 0
    still = np.stack([sleepy + 0.1, sleepy - 0.1, sleepy, sleepy], 1)
    facts[0, :3] = [0.2, 2.0, 0.7]
    assert (flag_chains(np.zeros(n, int), still, np.zeros(n, bool), facts, FaultModel()) == 1).sum() == 0
    monkeypatch.setattr(faults, "forward_backward", lambda emit, *args: np.tile([0.0, 0.0, 1.0, 0.0], (len(emit), 1)))
    assert (flag_chains(np.zeros(n, int), still, np.zeros(n, bool), _known(0.1), FaultModel()) == 1).sum() == 6


def test_a_busy_moment_is_parted(spark):
    rows = [("hot", 86_400_000 * 5 + 17 * i) for i in range(500)] + [("hot", 86_400_000 * 9), ("cold", 3)] + [("hot", 86_400_000 * 7)] * 40
    df = spark.createDataFrame(rows, "k string, t bigint")
    got = with_shards(df, "k", "t", rows=50, halo=5, bucket_ms=DAY_MS).collect()
    core = [r for r in got if r["__core"]]
    assert len(core) == len(rows) and max(np.unique([r["__shard"] for r in core if r.k == "hot"], return_counts=True)[1]) <= 150


@pytest.mark.parametrize(("rows", "halo", "bucket"), [(30, 5, 1000), (30, 29, 7000), (200, 10, 100), (1000, 5, 1000)])
def test_shards_are_unbroken_stretches_with_halo(spark, rows, halo, bucket):
    rng = np.random.default_rng(rows + halo)
    t = sorted(rng.choice(50_000, 300, replace=False).tolist())
    df = spark.createDataFrame([("hot", x) for x in t] + [("cold", 5), (None, 7), ("hot", None)], "k string, t bigint")
    got = with_shards(df, "k", "t", rows=rows, halo=halo, bucket_ms=bucket).toPandas()
    assert sorted(got[got["__core"]]["t"].tolist()) == sorted([*t, 5])
    hot = got[got["k"] == "hot"]
    for _, g in hot.groupby("__shard"):
        have, core = sorted(g["t"]), sorted(g[g["__core"]]["t"])
        a, z = t.index(core[0]), t.index(core[-1])
        assert core == t[a : z + 1] and have == t[t.index(have[0]) : t.index(have[-1]) + 1]
        assert t.index(have[0]) <= max(0, a - halo) and t.index(have[-1]) >= min(len(t) - 1, z + halo)


def test_trailing_totals(spark):
    d0 = date(2024, 2, 20)
    rows = [("a", 0, 5, 1), ("a", 0, None, 2), ("a", 3, 7, None), ("a", 45, 1, 1), ("b", 1, None, None), (None, 1, 5, 5), ("a", None, 9, 9)]
    df = spark.createDataFrame([(e, None if n is None else d0 + timedelta(n), v, c) for e, n, v, c in rows], "e string, d date, v bigint, c bigint").withColumns({"shown": F.lit(1), "__d": F.lit(2)})
    got = {(r.e, (r.d - d0).days): (r.v_7d, r.v_30d, r.c_7d, r.c_30d, r.v_30d_avg) for r in trailing_totals(df, entity="e", day="d", amounts=["v", "c"], windows=[7, 30]).collect()}
    want = {}
    for e in ("a", "b"):
        have = [(n, v or 0, c or 0) for x, n, v, c in rows if x == e and n is not None]
        for day in {n + i for n, _, _ in have for i in range(30)}:
            total = lambda w, k: sum(r[k] for r in have if day - w < r[0] <= day)  # noqa: E731, B023
            want[e, day] = (total(7, 1), total(30, 1), total(7, 2), total(30, 2), total(30, 1) / 30)
    assert got == want
    assert trailing_totals(df.limit(0), entity="e", day="d", amounts=["v"], windows=[7]).collect() == []
