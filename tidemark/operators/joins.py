"""As-of, range and interval joins without nested loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], direction: str = "backward", strict: bool = False) -> DataFrame:
    """``left`` with ``values`` of the nearest ``right`` row before (backward) or after (forward) it.

    Both sides go through one sort per key: rows are laid together by time and the last (or
    first) right value seen is carried along, so the work is n log n and nothing is paired."""
    first_right = (direction == "backward") != strict
    a = left.select(*keys, F.col(left_time).alias("__t"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__r"), F.lit(1 if first_right else 0).alias("__o"))
    b = right.select(*keys, F.col(right_time).alias("__t"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__l"), F.struct(*values).alias("__r"), F.lit(0 if first_right else 1).alias("__o"))
    w = Window.partitionBy(*keys).orderBy("__t", "__o")
    if direction == "backward":
        found = F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    else:
        found = F.first("__r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return a.unionByName(b).withColumn("__f", found).where("__l is not null").select("__l.*", *[F.col(f"__f.{v}").alias(v) for v in values])


def in_range(events: DataFrame, points: DataFrame, keys: Sequence[str], start: str, end: str, at: str, width: str = "1 day") -> DataFrame:
    """Points with start <= at <= end of each event; both sides meet on the time buckets an event spans."""
    seconds = {"1 day": 86400, "1 hour": 3600}[width]
    bucket = lambda c: F.floor(F.col(c).cast("timestamp").cast("double") / seconds).cast("long")
    spread = events.withColumn("__b", F.explode(F.sequence(bucket(start), bucket(end))))
    return spread.join(points.withColumn("__b", bucket(at)), [*keys, "__b"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__b")


def concurrency(events: DataFrame, bars: DataFrame, keys: Sequence[str], start: str, end: str, at: str) -> DataFrame:
    """Bars with the number of events that span them (both ends inclusive), by a sweep over starts and ends."""
    up = events.select(*keys, F.col(start).alias(at), F.lit(1).alias("__d"), F.lit(0).alias("__o"))
    down = events.select(*keys, F.col(end).alias(at), F.lit(-1).alias("__d"), F.lit(2).alias("__o"))
    here = bars.select(*keys, at, F.lit(0).alias("__d"), F.lit(1).alias("__o"))
    w = Window.partitionBy(*keys).orderBy(at, "__o").rowsBetween(Window.unboundedPreceding, 0)
    return up.unionByName(down).unionByName(here).withColumn("n_active", F.sum("__d").over(w)).where("__o = 1").drop("__d", "__o")


def purge(train: DataFrame, test: DataFrame, start: str, end: str, id: str = "id", width: str = "1 day") -> DataFrame:
    """Training intervals that overlap no test interval.

    Both sides meet on the time buckets they span. There an interval overlaps if, of the test intervals
    that start by its end, the furthest reaches its start: one sort a bucket, nothing is paired."""
    seconds = {"1 day": 86400, "1 hour": 3600}[width]
    bucket = lambda c: F.floor(F.col(c).cast("timestamp").cast("double") / seconds).cast("long")
    spread = lambda d, *cols: d.select(*cols, F.explode(F.sequence(bucket(start), bucket(end))).alias("__b"))
    held = spread(test, F.col(start).alias("__at"), F.col(end).alias("__e")).groupBy("__b", "__at").agg(F.max("__e").alias("__e"))
    reach = held.withColumn("__reach", F.max("__e").over(Window.partitionBy("__b").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)))
    near = as_of(spread(train, id, F.col(start), F.col(end).alias("__end")), reach, ["__b"], "__end", "__at", ["__reach"])
    return train.join(near.where(F.col("__reach") >= F.col(start)).select(id).distinct(), id, "left_anti")
