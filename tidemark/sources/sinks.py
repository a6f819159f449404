"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, one folder per value of ``by`` (ticker, theme, window); rows are dealt by them first."""
    if by:
        df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def csv(df: DataFrame, path: str, places: int | None = None) -> None:
    """CSV with fixed decimals, meant for small results."""
    if places is not None:
        df = df.select(*[F.format_string(f"%.{places}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    df.write.mode("overwrite").option("header", True).csv(path)


def tall(df: DataFrame) -> DataFrame:
    """A one-row result as metric, value."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in df.columns]).unpivot([], df.columns, "metric", "value")
