"""Scans with declared schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, schema: str, dates: dict[str, str] | None = None) -> DataFrame:
    """Headed CSV; ``dates`` maps columns to their formats. NaN becomes NULL in every double."""
    df = spark.read.schema(schema).option("header", True).option("nanValue", "NaN").csv(path)
    for name, form in (dates or {}).items():
        df = df.withColumn(name, F.to_date(F.col(name).cast("string"), form))
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def csv_directory(spark: SparkSession, path: str, schema: str, name: str = "ticker") -> DataFrame:
    """One file per entity: the file's stem becomes the column ``name``."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1))


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """Every text file under ``path`` as one row: path, text."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def tick_file(spark: SparkSession, path: str) -> DataFrame:
    """Headless tick CSV (date, time, price, bid, ask, size): ts, traded amounts; exact duplicates go."""
    df = spark.read.schema("date string, time string, price double, bid double, ask double, size long").csv(path)
    ts = F.to_timestamp(F.concat("date", "time"), "MM/dd/yyyyHH:mm:ss")
    return df.select(ts.alias("ts"), "price", "bid", "ask", "size", F.col("size").alias("v"), (F.col("price") * F.col("size")).alias("dv")).dropDuplicates()


def json_config(spark: SparkSession, path: str) -> dict:
    """A small JSON file as a dictionary, read through Spark so that any store works."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
