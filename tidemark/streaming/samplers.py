"""Stateful samplers over streams of ticks (k, ts, price, size)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def time_bars(ticks: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Windowed bars; rows later than ``late`` are dropped by the watermark."""
    return ticks.withWatermark("ts", late).groupBy("k", F.window("ts", width).alias("w")).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume")
    ).select("k", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def cusum(ticks: DataFrame, threshold: float) -> DataFrame:
    """Event times of the one-sided-reset CUSUM filter, with the two sums and the last price as state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down, last = state.get if state.exists else (0.0, 0.0, float("nan"))
        out = []
        for t, p in pd.concat(list(frames)).sort_values("ts")[["ts", "price"]].itertuples(index=False):
            change = 0.0 if last != last else p - last
            last = p
            up, down = max(0.0, up + change), min(0.0, down + change)
            if down < -threshold:
                down = 0.0
                out.append(t)
            elif up > threshold:
                up = 0.0
                out.append(t)
        state.update((up, down, last))
        yield pd.DataFrame({"k": [key[0]] * len(out), "event_time": out})

    return ticks.groupBy("k").applyInPandasWithState(run, "k long, event_time timestamp", "up double, down double, last double", "append", GroupStateTimeout.NoTimeout)


def reset_bars(ticks: DataFrame, amount: str, threshold: float) -> DataFrame:
    """Bars that close when the amount reaches the threshold and start anew without the remainder."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (held,) = state.get if state.exists else (0.0,)
        out = []
        for t, x in pd.concat(list(frames)).sort_values("ts")[["ts", amount]].itertuples(index=False):
            held += float(x)
            if held >= threshold:
                out.append(t)
                held = 0.0
        state.update((held,))
        yield pd.DataFrame({"k": [key[0]] * len(out), "time_close": out})

    return ticks.groupBy("k").applyInPandasWithState(run, "k long, time_close timestamp", "held double", "append", GroupStateTimeout.NoTimeout)
