import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import bars as B
from tidemark.operators import numeric as N
from tidemark.operators import windows as W
from tidemark.sources import generators, readers, sinks
from tidemark.streaming import samplers


def ticks(spark, prices, sizes=None):
    rows = [(1, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), float(p), int(s)) for i, (p, s) in enumerate(zip(prices, sizes or [1] * len(prices), strict=True))]
    return spark.createDataFrame(rows, "k long, ts timestamp, price double, size long")


def test_ewm_matches_pandas(spark):
    x = [1.0, 4.0, 2.0, 8.0, 5.0]
    df = ticks(spark, x)
    got = W.ewm(df, ["k"], "ts", "price", 3).orderBy("ts").toPandas()
    s = pd.Series(x)
    np.testing.assert_allclose(got["ewm_mean"], s.ewm(span=3).mean())
    np.testing.assert_allclose(got["ewm_recursive"], s.ewm(span=3, adjust=False).mean())
    np.testing.assert_allclose(got["ewm_std"].astype(float)[1:], s.ewm(span=3).std()[1:])


def brute_cusum(prices, h):
    up = down = 0.0
    out = []
    for i in range(1, len(prices)):
        d = prices[i] - prices[i - 1]
        up, down = max(0, up + d), min(0, down + d)
        if down < -h:
            down = 0
            out.append(i)
        elif up > h:
            up = 0
            out.append(i)
    return out


def test_cusum_and_stream_agree(spark, tmp_path):
    rng = np.random.default_rng(1)
    p = np.cumsum(rng.normal(0, 1, 80)).round(3).tolist()
    df = ticks(spark, p)
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("ts")
    got = B.cusum(df.withColumns({"d": F.col("price") - F.lag("price").over(w), "h": F.lit(2.0)}), ["k"], "d", "h").toPandas()
    want = brute_cusum(p, 2.0)
    assert [t.hour * 60 + t.minute for t in got["event_time"]] == want
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = samplers.cusum(stream, 2.0).writeStream.format("memory").queryName("cus").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(t.hour * 60 + t.minute for t in spark.table("cus").toPandas()["event_time"]) == want


def test_reset_bars_and_stream(spark, tmp_path):
    df = ticks(spark, [1] * 10, [3, 3, 3, 3, 3, 1, 1, 9, 2, 2])
    want = []
    held = 0
    for i, x in enumerate([3, 3, 3, 3, 3, 1, 1, 9, 2, 2]):
        held += x
        if held >= 8:
            want.append(i)
            held = 0
    assert [t.minute for t in B.reset_bars(df, ["k"], "size", 8).toPandas()["time_close"]] == want
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = samplers.reset_bars(stream, "size", 8).writeStream.format("memory").queryName("reset").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(t.minute for t in spark.table("reset").toPandas()["time_close"]) == want
    q = samplers.time_bars(stream, "5 minutes").writeStream.format("memory").queryName("tb").outputMode("append").start()
    q.processAllAvailable()
    q.stop()


def test_imbalance_bars_close_on_threshold(spark):
    got = B.imbalance_bars(ticks(spark, list(range(1, 12))), ["k"], "tick", first=3.0).toPandas()
    assert got["n_ticks"].iloc[0] == 4 and got["theta"].iloc[0] == 3.0


def test_scalars(spark):
    df = spark.createDataFrame([(float("nan"), "2024-06-03"), (0.0, "2024-06-01"), (-1.0, "2024-09-15"), (None, "2023-12-31")], "x double, d string").withColumn("d", F.to_date("d"))
    got = df.select(S.up_or_down(F.col("x")).alias("t"), S.safe_log(F.col("x")).alias("l"), S.month_end_weekday(F.col("d")).alias("e"), S.month_first_weekday(F.col("d")).alias("f")).collect()
    assert [r.t for r in got] == [-1, 1, -1, -1]
    assert got[1].l == 0.0
    assert [str(r.e) for r in got] == ["2024-06-28", "2024-06-28", "2024-09-30", "2023-12-29"]
    assert [str(r.f) for r in got] == ["2024-05-01", "2024-05-01", "2024-09-02", "2023-12-01"]
    cdf = spark.createDataFrame([(0.0,), (1.0,), (-1.96,)], "x double").select(S.normal_cdf(F.col("x"))).collect()
    np.testing.assert_allclose([r[0] for r in cdf], [0.5, 0.841344746, 0.024997895], atol=1e-6)
    s = spark.createDataFrame([("score 0.7",), ("1.9",), ("none",)], "t string").select(S.score_or_null(F.col("t"))).collect()
    assert [r[0] for r in s] == [0.7, 1.0, None]


def test_kernels():
    rng = np.random.default_rng(0)
    walk, noise = np.cumsum(rng.normal(size=300)), rng.normal(size=300)
    assert N.adf_statistic(noise) < -2.86 < N.adf_statistic(walk) + 2
    assert N.least_difference(noise) == 0.0
    x = rng.normal(size=(60, 8))
    c = N.ledoit_wolf(x)
    assert np.linalg.eigvalsh(c)[0] > 0
    w = N.hrp_weights(c)
    np.testing.assert_allclose(w.sum(), 1)
    assert (N.capped_min_variance(c, 0.2) <= 0.2 + 1e-6).all()
    mean, post = N.black_litterman(c, np.full(8, 1 / 8), np.full(8, 0.5), x.mean(0))
    assert mean.shape == (8,) and np.allclose(post, post.T)
    m, cov = N.ewm_moments(x, 10)
    want = pd.DataFrame(x).ewm(span=10).cov().loc[59]
    np.testing.assert_allclose(cov, want, rtol=1e-6)
    s = N.gaussian_states(np.concatenate([rng.normal(0, 0.1, 50), rng.normal(5, 0.1, 50), rng.normal(10, 0.1, 50)]))
    assert s[0] == 0 and s[75] == 1 and s[149] == 2
    assert sorted(N.single_linkage_order(np.array([[0.0], [10.0], [0.1], [10.1]]))) == [0, 1, 2, 3]


def test_sources_and_sinks(spark, tmp_path):
    g = generators.classification(spark, 100, 2, 1, 1)
    assert g.count() == 100 and {"I_0", "R_0", "N_0", "bin", "w", "t0", "t1"} <= set(g.columns)
    assert generators.random_walk(spark, 2, 10).count() == 20
    assert generators.correlated_returns(spark, 10, 2, 1).count() == 30
    assert {r.prediction for r in generators.signals(spark.range(50)).collect()} <= {-1, 1}
    df = spark.createDataFrame([("a", 20240131, 1.23456), ("b", 20240229, None)], "ticker string, date int, x double")
    sinks.csv(df.where("ticker = 'a'"), str(tmp_path / "c"), 4)
    back = readers.csv(spark, str(tmp_path / "c"), "ticker string, date int, x double", {"date": "yyyyMMdd"}).collect()
    assert str(back[0].date) == "2024-01-31" and back[0].x == 1.2346
    sinks.parquet(df, str(tmp_path / "p"), ["ticker"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("01/02/2024,09:30:00,10,9,11,5\n01/02/2024,09:30:00,10,9,11,5\n")
    assert readers.tick_file(spark, str(tmp_path / "t")).collect()[0].dv == 50.0
    assert readers.whole_texts(spark, str(tmp_path / "t")).count() == 1
    (tmp_path / "j.json").write_text('{"a": [1, 2]}')
    assert readers.json_config(spark, str(tmp_path / "j.json")) == {"a": [1, 2]}
    assert sinks.tall(spark.createDataFrame([(1.0, 2)], "a double, b int")).count() == 2
