"""Passes with carried state over many small batches, and kernels against brute force."""

import datetime as dt
import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import joins as J
from tidemark.operators import labels as L
from tidemark.operators import neighbours as K
from tidemark.operators import numeric as N
from tidemark.operators import windows as W

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def hot(spark, n=400):
    """Key 1 and the missing key each hold a third of the ticks."""
    rng = np.random.default_rng(3)
    keys = [1, None, 2, 3]
    rows = [(keys[int(k)], DAY + dt.timedelta(minutes=i), float(p), int(s)) for i, (k, p, s) in enumerate(zip(rng.choice(4, n, p=[0.35, 0.35, 0.2, 0.1]), rng.normal(0, 3, n).cumsum().round(3), rng.integers(1, 9, n), strict=True))]
    return rows, spark.createDataFrame(rows, "k long, ts timestamp, price double, size long")


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_state_crosses_batches(spark, small_batches):
    rows, df = hot(spark)
    want_reset, want_cusum = set(), set()
    for k, rs in by_key(rows).items():
        total = up = down = 0.0
        last = None
        for _, t, p, s in rs:
            total += s
            if total >= 20:
                want_reset.add((k, t))
                total = 0
            if last is not None:
                up, down = max(0, up + p - last), min(0, down + p - last)
                if down < -5 or up > 5:
                    want_cusum.add((k, t))
                    up, down = (up, 0) if down < -5 else (0, down)
            last = p
    got = B.reset_bars(df, ["k"], "size", 20).collect()
    assert {(r.k, r.time_close) for r in got} == want_reset and len(got) == len(want_reset)
    w = Window.partitionBy("k").orderBy("ts")
    got = B.cusum(df.withColumns({"d": F.col("price") - F.lag("price").over(w), "h": F.lit(5.0)}), ["k"], "d", "h").collect()
    assert {(r.k, r.event_time) for r in got} == want_cusum and len(got) == len(want_cusum)


def test_imbalance_bars_over_batches(spark, small_batches):
    rows, df = hot(spark)
    want = []
    for k, rs in by_key(rows).items():
        length = mean = last = opened = None
        theta = count = 0
        for _, t, p, s in rs:
            sign = 0 if last is None or p == last else (1 if p > last else -1)
            last, opened = p, opened or t
            theta, count = theta + sign * s, count + 1
            if abs(theta) >= max((length or 0) * abs(mean or 0), 12):
                want.append((k, opened, t, count, theta))
                length = count if length is None else count / 3 + length * 2 / 3
                mean = theta / count if mean is None else theta / count / 3 + mean * 2 / 3
                theta = count = 0
                opened = None
    got = [tuple(r) for r in B.imbalance_bars(df, ["k"], "volume", first=12.0).collect()]
    assert sorted(got, key=repr) == sorted([(*w[:4], float(w[4])) for w in want], key=repr)


def test_ewm_with_gaps(spark, small_batches):
    rows, df = hot(spark)
    df = df.withColumn("price", F.when(F.minute("ts") % 4 != 1, F.col("price")))
    got = {(r.k, r.ts): (r.ewm_mean, r.ewm_recursive, r.ewm_std) for r in W.ewm(df, ["k"], "ts", "price", 6).collect()}
    assert len(got) == len(rows)
    for k, rs in by_key(rows).items():
        x = pd.Series([p if t.minute % 4 != 1 else math.nan for _, t, p, _ in rs])
        e = x.ewm(span=6)
        want = np.stack([e.mean(), x.ewm(span=6, adjust=False).mean(), e.std()], 1)
        have = np.array([[math.nan if v is None else v for v in got[k, t]] for _, t, _, _ in rs])
        np.testing.assert_allclose(have, want, rtol=1e-9)


def test_growth_ends_with_a_total_loss(spark):
    x = [0.1, None, -0.5, -1.0, 0.2]
    y = [0.1, -1.5, 0.5, -3.0, 0.0]
    df = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k long, i long, x double, y double")
    run = W.upto(["k"], ["i"])
    got = df.select("i", W.growth(F.col("x"), run).alias("x"), W.growth(F.col("y"), run).alias("y")).orderBy("i").collect()
    assert got[1].x is None
    np.testing.assert_allclose([r.x for r in got if r.x is not None], [1.1, 0.55, 0, 0])
    np.testing.assert_allclose([r.y for r in got], np.cumprod(1 + np.array(y)))


def test_purge_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    at = lambda h: DAY + dt.timedelta(hours=float(h))
    make = lambda n, reach: [(i, at(a), at(a + b)) for i, (a, b) in enumerate(zip(rng.uniform(0, 600, n).round(), rng.uniform(0, reach, n).round(), strict=True))]
    train, test = make(300, 40), make(12, 60)
    want = sorted(i for i, a, b in train if not any(a <= e and b >= s for _, s, e in test))
    schema = "id long, t0 timestamp, t1 timestamp"
    assert sorted(r.id for r in J.purge(spark.createDataFrame(train, schema), spark.createDataFrame(test, schema), "t0", "t1").collect()) == want and want
    assert J.purge(spark.createDataFrame(train, schema), spark.createDataFrame([], schema), "t0", "t1").count() == 300


def test_numbering_of_equal_times(spark):
    df = spark.createDataFrame([(i * 37 % 500, DAY if i % 3 else None) for i in range(500)], "id long, ts timestamp").repartition(5)
    got = L.numbered(df, ["ts", "id"]).orderBy("__i").collect()
    assert [r["__i"] for r in got] == list(range(500)) and {r["__n"] for r in got} == {500}
    assert [r.id for r in got] == [r.id for r in df.orderBy("ts", "id").collect()]


def test_median_and_signed_sum(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (1, 4.0), (None, None), (None, 7.0), (2, None)], "m long, x double")
    got = sorted(((r.m, r.x) for r in W.fill_median(df, "x", ["m"]).collect()), key=repr)
    assert got == sorted([(1, 1.0), (1, 2.5), (1, 4.0), (None, 7.0), (None, 7.0), (2, None)], key=repr)
    with pytest.warns(UserWarning, match="gone"):
        total = W.signed_sum({"x": -1, "gone": 1}, df.columns)
    assert [r[0] for r in df.where("x = 4").select(total).collect()] == [-4.0]


def test_ranks_scaled(spark):
    x = [3.0, 1.0, None, 3.0, 2.0]
    df = spark.createDataFrame([(1, v) for v in x] + [(2, 5.0), (2, 5.0)], "m long, x double")
    got = [(r.m, r.x, r.s) for r in df.select("m", "x", W.rank_scaled(F.col("x"), ["m"]).alias("s")).collect()]
    assert set(got) == {(1, 3.0, 1.0), (1, 1.0, -1.0), (1, None, 0.0), (1, 2.0, 0.0), (2, 5.0, 0.0)}


def test_sup_adf_against_every_regression():
    x = np.random.default_rng(4).normal(size=60).cumsum()
    want = np.full(60, math.nan)
    for end in range(20, 61):
        want[end - 1] = max(N.adf_statistic(x[s:end], 1, True) for s in range(end - 19))
    np.testing.assert_allclose(N.sup_adf(x, 20), want, rtol=1e-6)
    assert np.isnan(N.sup_adf(x[:10])).all()


def line(spark, prices, sizes):
    rows = [(1, DAY + dt.timedelta(minutes=i), float(p), int(s)) for i, (p, s) in enumerate(zip(prices, sizes, strict=True))]
    return spark.createDataFrame(rows, "k long, ts timestamp, price double, size long")


def test_an_imbalance_that_meets_its_bound_rounds_as_in_sql(spark):
    """The third bar's bound is its imbalance but for rounding: by SQL it closes later (F7)."""
    signed = [0, 45, -92, 0, -25, -38, 11, -76, -17, 44, -46, 28, -67, -49, 18, -89, 0, -68, -33, -28, 2, -49, 23, -99]
    got = B.imbalance_bars(line(spark, 1000 + np.cumsum(np.sign(signed)), np.abs(signed)), ["k"], "volume", first=150.0)
    assert sorted((r.n_ticks, r.theta) for r in got.collect()) == [(8, -252.0), (8, -178.0), (8, -175.0)]


def test_barriers_round_as_in_sql(spark):
    """1.5 * 8 / 20 is below 12.8 / 8 - 1, 1.5 * (8 / 20) isn't (F8)."""
    e = spark.createDataFrame([(1, 1, DAY, DAY + dt.timedelta(hours=1), 8.0, 8.0)], "id long, k long, t0 timestamp, t1 timestamp, p0 double, trgt double")
    got = L.barrier_events(e, line(spark, [8, 12.8], [1, 1]), ["k"], 1.5, 1.0, 0.25, unit=20.0).first()
    assert got.first_touch == 1 and got.end == DAY + dt.timedelta(minutes=1)


def test_dollar_bars_sum_exactly(spark):
    """Ten times 0.1 are a full dollar, however doubles round (F6)."""
    got = line(spark, [0.1] * 30, [1] * 30).withColumn("bar", B.bar_id("dollar", ["k"], 1)).orderBy("ts").collect()
    assert [r.bar for r in got] == [(i + 1) // 10 for i in range(30)]


def test_nearest_rows_meet_in_blocks(spark):
    """Blocks of 16 rows, holes in the measures and many ties: as by brute force (F1)."""
    rng = np.random.default_rng(4)
    rows = [(int(i % 2), int(i), *(None if rng.random() < 0.1 else float(v) for v in rng.integers(0, 5, 3)), None if rng.random() < 0.3 else float(i)) for i in range(160)]
    want = {}
    for m, e, *x, gap in rows:
        near = []
        for m2, e2, *y, v in rows:
            both = [(a - b) ** 2 for a, b in zip(x, y, strict=True) if a is not None and b is not None]
            if m2 == m and v is not None and both:
                near.append((sum(both) * 3 / len(both), e2, v))
        want[m, e] = gap if gap is not None else float(np.mean([v for *_, v in sorted(near)[:5]])) if near else None
    df = spark.createDataFrame(rows, "month int, entity long, px double, qty double, tax double, gap double")
    for size in (16, 1 << 18):
        got = {(r.month, r.entity): r.gap for r in K.impute(df, ["month"], "entity", "gap", ["px", "qty", "tax"], block=size).collect()}
        assert got.keys() == want.keys()
        np.testing.assert_allclose([got[c] if got[c] is not None else np.nan for c in want], [np.nan if v is None else v for v in want.values()])


def test_sequential_bootstrap_of_a_long_key():
    """Small keys draw as by the definition; 20,000 events are minutes of work by it (F9)."""
    rng = np.random.default_rng(2)
    for trial in range(20):
        n = int(rng.integers(1, 150))
        a = rng.integers(0, n, n) if trial % 2 else np.arange(n)
        spans = list(zip(a.tolist(), np.minimum(n - 1, a + rng.integers(0, 9, n)).tolist(), strict=True))
        own, held, want = np.random.default_rng(trial), np.zeros(n), []
        for _ in range(n):
            unique = np.array([np.mean(1 / (held[i : j + 1] + 1)) for i, j in spans])
            want.append(int(own.choice(n, p=unique / unique.sum())))
            held[spans[want[-1]][0] : spans[want[-1]][1] + 1] += 1
        assert N.sequential_bootstrap(spans, n, seed=trial) == want
    began = time.process_time()
    assert len(N.sequential_bootstrap([(i, min(i + 3, 19_999)) for i in range(20_000)], 20_000)) == 20_000
    assert time.process_time() - began < 60


def test_sup_adf_solves_without_pseudo_inverses(monkeypatch):
    """All starts of many ends are solved together; only near-singular regressions are inverted one by one (F10)."""
    x = np.random.default_rng(6).normal(size=60).cumsum()
    monkeypatch.setattr(N, "_level_statistic", None, raising=True)
    got = N.sup_adf(x, 20, chunk=100)
    monkeypatch.undo()
    want = [max(N.adf_statistic(x[s:e], trend=True) for s in range(e - 19)) for e in range(20, 61)]
    assert np.isnan(got[:19]).all()
    np.testing.assert_allclose(got[19:], want, rtol=1e-7)
    assert np.isnan(N.sup_adf(np.full(30, 2.0), 20)).all()
