"""Bars and event samplers over ticks (key, ts, price, size)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequential import scan


def ohlcv(ticks: DataFrame, keys: Sequence[str], ts: str = "ts", price: str = "price", size: str = "size") -> DataFrame:
    return ticks.groupBy(*keys).agg(
        F.min(ts).alias("time_open"), F.max(ts).alias("time_close"), F.min_by(price, ts).alias("open"), F.min(price).alias("low"), F.max(price).alias("high"), F.max_by(price, ts).alias("close"),
        F.try_divide(F.sum(F.col(price) * F.col(size)), F.sum(size)).alias("vwap"), F.sum(size).alias("volume"),
    )


def bar_id(kind: str, key: Sequence[str], threshold: float, ts: str = "ts", price: str = "price", size: str = "size") -> Column:
    """Number of the tick, volume or dollar bar a tick falls in: the running amount over the threshold.

    Money is summed in decimals: a tick that meets a threshold exactly opens its bar whatever was summed before."""
    w = Window.partitionBy(*key).orderBy(ts)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    amount = {"tick": F.row_number().over(w) - 1, "volume": F.sum(size).over(run), "dollar": F.sum((F.col(price) * F.col(size)).cast("decimal(38,6)")).over(run).cast("double")}[kind]
    return F.floor(amount / threshold).cast("long")


def tick_sign(price: str, w) -> Column:
    """Sign of the price change, 0 without one; nothing is carried forward."""
    return F.coalesce(F.signum(F.col(price) - F.lag(price).over(w)), F.lit(0.0)).cast("int")


def reset_bars(ticks: DataFrame, key: Sequence[str], amount: str, threshold: float, ts: str = "ts") -> DataFrame:
    """Closing times of bars whose amount reaches the threshold; the remainder is dropped on closing."""

    def step(total, amounts):
        total, hits = total or 0.0, []
        for i, x in enumerate(amounts):
            total += x
            if total >= threshold:
                total = 0.0
                hits.append(i)
        return total, hits

    t = ticks.where(F.col(amount).isNotNull()).select(*key, F.col(ts).cast("timestamp").alias("time_close"), F.col(amount).cast("double").alias("__x"))
    return scan(t, key, ["time_close", "__x"], ["__x"], step, [*key, "time_close"], "")


def cusum(ticks: DataFrame, key: Sequence[str], change: str, threshold: str, ts: str = "ts") -> DataFrame:
    """Times at which the running sum of changes leaves (-h, h); only the side that fired starts anew."""

    def step(state, changes, limits):
        (up, down), hits = state or (0.0, 0.0), []
        for i, (d, h) in enumerate(zip(changes, limits, strict=True)):
            up, down = max(0.0, up + d), min(0.0, down + d)
            if down < -h:
                down = 0.0
                hits.append(i)
            elif up > h:
                up = 0.0
                hits.append(i)
        return (up, down), hits

    t = ticks.where(F.col(change).isNotNull()).select(*key, F.col(ts).cast("timestamp").alias("event_time"), F.col(change).cast("double").alias("__d"), F.col(threshold).cast("double").alias("__h"))
    return scan(t, key, ["event_time", "__d", "__h"], ["__d", "__h"], step, [*key, "event_time"], "")


def imbalance_bars(ticks: DataFrame, key: Sequence[str], kind: str = "tick", first: float = 20.0, span: int = 5) -> DataFrame:
    """Bars that close when the signed amount exceeds what past bars lead one to expect.

    A bar closes when |sum of signed amounts| >= max(E[length] * |E[signed amount]|, first);
    the expectations are exponentially weighted over past bars."""
    n = (span + 1) / 2  # divided by, as in SQL: a bar that meets its bound exactly then closes in both
    rest = 1 - 1 / n
    amount = {"tick": F.lit(1.0), "volume": F.col("size"), "dollar": F.col("price") * F.col("size")}[kind]

    def step(state, signed, times):
        opened, theta, count, length, mean = state or (None, 0.0, 0, None, None)
        hits, opens, counts, thetas = [], [], [], []
        for i, (x, t) in enumerate(zip(signed, times, strict=True)):
            opened = t if opened is None else opened
            theta += x
            count += 1
            if abs(theta) >= max((length or 0) * abs(mean or 0), first):
                hits.append(i)
                opens.append(opened)
                counts.append(count)
                thetas.append(theta)
                length = float(count) if length is None else count / n + rest * length
                mean = theta / count if mean is None else theta / count / n + rest * mean
                opened, theta, count = None, 0.0, 0
        return (opened, theta, count, length, mean), hits, opens, counts, thetas

    w = Window.partitionBy(*key).orderBy("time_close")
    t = ticks.select(*key, F.col("ts").cast("timestamp").alias("time_close"), "price", F.col("size").cast("double").alias("size"))
    t = t.select(*key, "time_close", (tick_sign("price", w) * F.coalesce(amount, F.lit(0.0))).cast("double").alias("__x"))
    out = scan(t, key, ["time_close"], ["__x", "time_close"], step, [*key, "time_close"], "time_open timestamp, n_ticks long, theta double")
    return out.select(*key, "time_open", "time_close", "n_ticks", "theta")
