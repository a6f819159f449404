"""Synthetic inputs; every one is a function of its seed and its row number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def classification(spark: SparkSession, n: int = 10_000, informative: int = 10, redundant: int = 10, noise: int = 20, seed: int = 0, days: int = 1) -> DataFrame:
    """Informative, redundant (mixes of two informative) and noise columns, a label, weight 1/n and label spans."""
    df = spark.range(n)
    i = {f"I_{k}": F.randn(seed + k) for k in range(informative)}
    df = df.withColumns(i)
    df = df.withColumns({f"R_{k}": F.col(f"I_{k % informative}") * 0.7 + F.col(f"I_{(k + 1) % informative}") * 0.3 for k in range(redundant)})
    df = df.withColumns({f"N_{k}": F.randn(seed + 1000 + k) for k in range(noise)})
    total = sum((F.col(c) for c in i), F.lit(0.0))
    start = F.timestamp_seconds(F.lit(1_262_304_000) + F.col("id") * 86_400 * days)
    return df.withColumns({"bin": (total + 0.5 * F.randn(seed + 2000) > 0).cast("int"), "w": F.lit(1.0 / n), "t0": start, "t1": start + F.expr(f"interval {days} day")}).drop("id")


def random_walk(spark: SparkSession, keys: int, n: int, drift: float = 0.0, sigma: float = 0.01, start: float = 100.0, seed: int = 0) -> DataFrame:
    """Geometric random walks: k, i, price."""
    df = spark.range(keys * n).select((F.col("id") % keys).alias("k"), F.floor(F.col("id") / keys).alias("i"), F.randn(seed).alias("z"))
    w = Window.partitionBy("k").orderBy("i")
    return df.select("k", "i", (start * F.exp(F.sum(drift + sigma * F.col("z")).over(w))).alias("price"))


def label_ends(events: DataFrame, start: str, days: int, seed: int = 0) -> DataFrame:
    return events.withColumn("t1", F.col(start) + F.make_dt_interval(days=F.floor(F.rand(seed) * days).cast("int") + 1))


def signals(df: DataFrame, seed: int = 0) -> DataFrame:
    """A random prediction in {-1, 1} and its probability."""
    u = F.rand(seed) * 2 - 1
    return df.withColumn("__u", u).withColumns({"prediction": F.signum("__u").cast("int"), "probability": F.abs("__u")}).drop("__u")


def correlated_returns(spark: SparkSession, n: int, base: int, copies: int, sigma: float = 0.25, seed: int = 0) -> DataFrame:
    """Long form t, asset, ret: independent columns and noisy copies of them."""
    df = spark.range(n).withColumns({f"a{k}": F.randn(seed + k) for k in range(base)})
    df = df.withColumns({f"a{base + k}": F.col(f"a{k % base}") + sigma * F.randn(seed + 500 + k) for k in range(copies)})
    return df.withColumnRenamed("id", "t").unpivot(["t"], [f"a{k}" for k in range(base + copies)], "asset", "ret")


def probe(df: DataFrame, seed: int = 0) -> DataFrame:
    return df.withColumn("random", (F.floor(F.rand(seed) * 100) + 1).cast("int"))
