"""Aggregates: return statistics, hits and misses, moments, classification, splits, fractional differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import float_div, normal_cdf
from .windows import growth, rolling


def hit_miss(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    up, down = F.when(F.col(x) > 0, F.col(x)), F.when(F.col(x) < 0, F.col(x))
    return df.groupBy(*keys).agg(F.count(up).alias("hits"), F.count(down).alias("misses"), F.avg(up).alias("mean_hit"), F.avg(down).alias("mean_miss"), F.sum(x).alias("total"))


def return_statistics(df: DataFrame, time: str, r: str, b: str) -> DataFrame:
    """One row of statistics of a monthly return series ``r`` against a benchmark ``b`` (one row a month).

    Drawdown is measured on the cumulative return, not on wealth. A ratio to a deviation or drawdown of 0 is
    an infinity (NaN for 0 / 0), as in SQL."""
    w = Window.orderBy(time)
    c = df.withColumn("c", growth(F.col(r), w) - 1).withColumn("top", F.max("c").over(w)).withColumn("dd", F.when(F.col("top") != 0, (F.col("c") - F.col("top")) / F.col("top")))
    n, active = F.count(F.lit(1)), F.col(r) - F.col(b)
    total, sd = F.max_by("c", time), F.stddev_samp(r)
    annual = F.pow(1 + total, 12.0 / n) - 1
    six = lambda x: F.round(x, 6)
    return c.agg(
        n.alias("n"), F.round(total, 5).alias("total"), six(annual).alias("annual_return"), six(12 * F.avg(r)).alias("average_annual"), six(12**0.5 * sd).alias("annual_vol"), six(float_div(12 * F.avg(r), 12**0.5 * sd)).alias("sharpe"),
        F.round(F.min("dd"), 5).alias("max_drawdown"), six(F.count_if(F.col("dd") < 0) / 12.0).alias("under_water"), six(F.min(r)).alias("worst_month"), six(float_div(12 * F.avg(active), 12**0.5 * F.stddev_samp(active))).alias("information_ratio"),
        six(12 * F.regr_intercept(F.col(r), F.col(b))).alias("alpha"), six(12**0.5 * (sd - F.stddev_samp(b))).alias("tracking_error"), six(float_div(F.covar_pop(r, b), F.stddev_pop(r) * F.stddev_pop(b))).alias("correlation"),
        six(normal_cdf(float_div(F.avg(r), sd) * F.sqrt(n))).alias("psr"), six(float_div(annual, F.abs(F.min("dd")))).alias("calmar"),
    )


def turnover(df: DataFrame, entity: str, time: str, weight: str) -> DataFrame:
    """Mean over time of the summed absolute weight changes (an entity's first date counts nothing)."""
    change = F.coalesce(F.abs(F.col(weight) - F.lag(weight).over(Window.partitionBy(entity).orderBy(time))), F.lit(0.0))
    return df.withColumn("__d", change).groupBy(time).agg(F.sum("__d").alias("t")).agg(F.avg("t").alias("turnover"))


def describe(df: DataFrame, x: str) -> DataFrame:
    q = lambda p: F.percentile(x, p)
    return df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("low"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.max(x).alias("high"), F.count(x).alias("n"))


def moments(df: DataFrame, x: str) -> DataFrame:
    s = df.agg(F.count(x).alias("n"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis"))
    n = F.col("n")
    return s.withColumns({"jarque_bera": n / 6.0 * (F.pow("skew", F.lit(2)) + F.pow("kurtosis", F.lit(2)) / 4), "sample_skew": F.sqrt(n * (n - 1.0)) / (n - 2.0) * F.col("skew")})


def time_decay(df: DataFrame, time: str, amount: str, last: float) -> DataFrame:
    """Weights that fall with the share of later amounts; summed per period first, so the running sum is short."""
    c = df.groupBy(time).agg(F.sum(amount).alias("n"))
    r = c.select(time, F.sum("n").over(Window.orderBy(time)).alias("s"), F.sum("n").over(Window.partitionBy()).alias("t"))
    slope = (1 - last) / F.col("t")
    return r.select(time, F.round(F.greatest(F.lit(0.0), slope * F.col("s") + 1 - slope * F.col("t")), 6).alias("linear"), F.round(F.pow(F.lit(last), 1 - F.col("s") / F.col("t")), 6).alias("exponential"))


def technical(df: DataFrame, w, x: str, n: int, m: int) -> DataFrame:
    """Bollinger bands over n rows and the relative strength index over m changes; incomplete rows go."""
    ma, sd = rolling(F.avg, F.col(x), w, n), rolling(F.stddev_samp, F.col(x), w, n)
    out = df.withColumns({"upper": ma + 2 * sd, "lower": ma - 2 * sd, "__c": F.col(x) - F.lag(x).over(w)})
    up, down = F.when(F.col("__c").isNotNull(), F.greatest("__c", F.lit(0.0))), F.when(F.col("__c").isNotNull(), F.greatest(-F.col("__c"), F.lit(0.0)))
    out = out.withColumns({"__u": rolling(F.avg, up, w, m), "__d": rolling(F.avg, down, w, m)}).where("upper is not null and __u is not null and __d > 0")
    return out.withColumn("rsi", 100 - 100 / (1 + F.col("__u") / F.col("__d"))).drop("__c", "__u", "__d")


def classification(df: DataFrame, y: str, p: str, s: str) -> DataFrame:
    """Accuracy, precision, recall, rank-sum AUC (ties averaged) and log loss.

    Ranks come from counts per distinct score, so only those are ordered globally."""
    per = df.groupBy(s).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"), F.sum((F.col(p) == F.col(y)).cast("int")).alias("ok"), F.sum(p).alias("pp"), F.sum(F.col(p) * F.col(y)).alias("tp"), F.sum(F.col(y) * F.log(F.col(s)) + (1 - F.col(y)) * F.log(1 - F.col(s))).alias("ll"))
    ranked = per.withColumn("r", F.sum("n").over(Window.orderBy(s)) - (F.col("n") - 1) / 2.0)
    t = ranked.agg(*[F.sum(c).alias(c) for c in ("n", "pos", "ok", "pp", "tp", "ll")], F.sum(F.col("r") * F.col("pos")).alias("rs"))
    c = F.col
    return t.select(F.round(c("ok") / c("n"), 6).alias("accuracy"), F.round(c("tp") / c("pp"), 6).alias("precis"), F.round(c("tp") / c("pos"), 6).alias("recall"), F.round((c("rs") - c("pos") * (c("pos") + 1) / 2.0) / (c("pos").cast("double") * (c("n") - c("pos"))), 6).alias("auc"), F.round(-c("ll") / c("n"), 6).alias("log_loss"))


def rolling_splits(df: DataFrame, time: str, start: str, count: int, train: int, val: int, test: int) -> DataFrame:
    """Sizes of the half-open training, validation and test spans of each yearly window."""
    at = lambda years: F.add_months(F.lit(start).cast("date"), F.col("window_id") * 12 + years * 12)
    w = df.withColumn("window_id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    within = lambda a, b: F.count_if((F.col(time) >= at(a)) & (F.col(time) < at(b)))
    return w.groupBy("window_id").agg(within(0, train).alias("n_train"), within(train, train + val).alias("n_val"), within(train + val, train + val + test).alias("n_test"))


def ffd_weights(d: float, size: int | None = None, threshold: float = 0.01) -> list[float]:
    """Weights of a fractional difference, newest first, to a size or down to the first one under the threshold."""
    w = [1.0]
    while len(w) < size if size else abs(w[-1]) >= threshold:
        w.append(-w[-1] * (d - len(w) + 1) / len(w))
    return w


def frac_diff(x: Column, w, weights: list[float]) -> Column:
    out = x * F.lit(weights[0])
    for k, v in enumerate(weights[1:], 1):
        out = out + F.lag(x, k).over(w) * F.lit(v)
    return out
