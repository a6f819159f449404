"""Top-k selections per date and duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], score: Column, k: int, ties: Sequence[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(score.desc_nulls_last(), *ties))
    return df.withColumn("pick", rank).where(F.col("pick") <= k)


def long_only(df: DataFrame, keys: Sequence[str], signal: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The k strongest positive signals of each date (fewer where fewer are positive)."""
    return top_k(df.where(F.col(signal) > 0), keys, F.col(signal), k, ties)


def long_short(df: DataFrame, keys: Sequence[str], signal: str, k: int, ties: Sequence[str]) -> DataFrame:
    """Half of k from the top as side 1, half from the bottom as side -1."""
    high = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(signal).desc(), *ties))
    low = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(signal).asc(), *ties))
    ranked = df.where(F.col(signal).isNotNull()).withColumns({"__h": high, "__l": low})
    side = F.when(F.col("__h") <= k // 2, 1).when(F.col("__l") <= k // 2, -1)
    return ranked.withColumn("side", side).where("side is not null").drop("__h", "__l")


def capped_turnover(now: DataFrame, before: DataFrame, entity: str, signal: str, k: int, keep: float = 0.75) -> DataFrame:
    """Three quarters of the last ranking's best that are still listed, filled up from the current ranking."""
    rank = lambda d: d.withColumn("__r", F.row_number().over(Window.partitionBy("period").orderBy(F.col(signal).desc(), entity)))
    kept = rank(before).where(F.col("__r") <= int(k * keep)).select("period", entity).withColumn("__kept", F.lit(1))
    both = now.join(kept, ["period", entity], "left")
    order = Window.partitionBy("period").orderBy(F.col("__kept").desc_nulls_last(), F.col(signal).desc(), entity)
    return both.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= k).withColumn("kept", F.coalesce("__kept", F.lit(0))).drop("__kept")


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def beats_probe(scores: DataFrame, probe: str, limit: int) -> DataFrame:
    """Features that some method ranks above the random probe, best average of normalised scores first.

    ``scores``: method, feature, score."""
    w = Window.partitionBy("method")
    ranked = scores.withColumns({"__p": F.max(F.when(F.col("feature") == probe, F.col("score"))).over(w), "share": F.col("score") / F.sum("score").over(w)})
    good = ranked.where("score > __p").select("feature").distinct()
    return ranked.join(good, "feature", "left_semi").groupBy("feature").agg(F.avg("share").alias("mean_share")).orderBy(F.desc("mean_share"), "feature").limit(limit)
