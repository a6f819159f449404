"""Registry of queries and their DuckDB counterparts, and the tables derived from the inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The monthly panel as common table expressions: measures are sums of whole cents and hundredths, so they don't depend on row order.
PANEL_SQL = """
p0 as (select l_suppkey as entity, cast(date_trunc('month', l_shipdate) as date) as month,
    sum(cast(round(l_extendedprice * 100) as bigint)) / (100.0 * sum(cast(l_quantity as bigint))) as px,
    cast(sum(cast(l_quantity as bigint)) as double) as qty, sum(cast(round(l_discount * 100) as bigint)) / (100.0 * count(*)) as disc,
    sum(cast(round(l_tax * 100) as bigint)) / (100.0 * count(*)) as tax, count(*) as n from lineitem where l_shipdate is not null group by 1, 2),
panel as (select *, px / lag(px) over (partition by entity order by month) - 1 as ret, case when n % 5 <> 0 then disc end as gap from p0),
m0 as (select cast(date_trunc('month', l_shipdate) as date) as month, sum(cast(round(l_extendedprice * 100) as bigint)) / (100.0 * sum(cast(l_quantity as bigint))) as px
    from lineitem where l_shipdate is not null group by 1),
market as (select month, px / lag(px) over (order by month) - 1 as mret from m0)
"""
TICKS_SQL = """
ticks as (select event_id, user_id as k, cast(ts as timestamp) as ts, value as price, cast(json_extract_string(props, '$.k') as bigint) as size from events where value is not null and ts is not null)
"""


def query(name: str, sql: str | None = None, base: str = PANEL_SQL):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            body = sql.lstrip()
            recursive = body.startswith("+ recursive")
            body = body.removeprefix("+ recursive").removeprefix("+") if body.startswith("+") else body
            ORACLES[name] = f"with {'recursive ' if recursive else ''}{base.strip()}{',' if sql.lstrip().startswith('+') else ''} {body}"
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _measures(df: DataFrame, *keys) -> DataFrame:
    hundredths = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    n = F.count(F.lit(1))
    return df.where("l_shipdate is not null").groupBy(*keys, F.trunc("l_shipdate", "month").alias("month")).agg(
        (hundredths("l_extendedprice") / (F.lit(100.0) * F.sum(F.col("l_quantity").cast("long")))).alias("px"),
        F.sum(F.col("l_quantity").cast("long")).cast("double").alias("qty"), (hundredths("l_discount") / (F.lit(100.0) * n)).alias("disc"), (hundredths("l_tax") / (F.lit(100.0) * n)).alias("tax"), n.alias("n"),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, month, px, qty, disc, tax, n, ret, gap (disc with holes)."""
    w = Window.partitionBy("entity").orderBy("month")
    p = _measures(read(spark, sf_dir, "lineitem"), F.col("l_suppkey").alias("entity"))
    return p.withColumns({"ret": F.col("px") / F.lag("px").over(w) - 1, "gap": F.when(F.col("n") % 5 != 0, F.col("disc"))})


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a month, so its global window is small at any size."""
    m = _measures(read(spark, sf_dir, "lineitem"))
    return m.select("month", (F.col("px") / F.lag("px").over(Window.orderBy("month")) - 1).alias("mret"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").where("value is not null and ts is not null")
    return e.select("event_id", F.col("user_id").alias("k"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("size"))


def rounded(*names: str, places: int = 6):
    return [F.round(F.col(n), places).alias(n) for n in names]
