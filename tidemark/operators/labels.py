"""Event labels, sample weights and cross-validation splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import as_of, concurrency, in_range
from .lineage import durable


def vertical_barrier(events: DataFrame, bars: DataFrame, key: Sequence[str], days: float, start: str = "t0", ts: str = "ts") -> DataFrame:
    """``t1``: the first bar at or after start plus ``days``; events without one are dropped."""
    due = events.withColumn("__due", F.col(start) + F.expr(f"make_dt_interval({days})"))
    stop = bars.select(*key, ts, F.col(ts).alias("t1"))
    return as_of(due, stop, key, "__due", ts, ["t1"], "forward").where("t1 is not null").drop("__due")


def triple_barrier(events: DataFrame, path: DataFrame, key: Sequence[str], take: float, stop: float, unit: float = 1.0) -> DataFrame:
    """First of profit take, stop loss and ``t1`` for events (id, t0, t1, p0, trgt, side); a multiplier of 0 or less is no barrier.

    A barrier is multiplier * trgt / unit, rounded in that order.

    Adds sl, pt (first touches, strict), end (the earliest) and first_touch (1 take, -1 stop, 0 neither)."""
    moves = in_range(events, path.select(*key, F.col("ts"), F.col("price").alias("p")), key, "t0", "t1", "ts").withColumn("r", (F.col("p") / F.col("p0") - 1) * F.col("side"))
    low = F.when((F.lit(stop) > 0) & (F.col("r") < -stop * F.col("trgt") / unit), F.col("ts"))
    high = F.when((F.lit(take) > 0) & (F.col("r") > take * F.col("trgt") / unit), F.col("ts"))
    touched = moves.groupBy(*key, "id").agg(F.min(low).alias("sl"), F.min(high).alias("pt"))
    out = events.join(touched, [*key, "id"], "left").withColumn("end", F.least("t1", "sl", "pt"))
    first = F.when(F.col("pt").isNotNull() & (F.col("sl").isNull() | (F.col("pt") < F.col("sl"))), 1).when(F.col("sl").isNotNull(), -1).otherwise(0)
    return out.withColumn("first_touch", first)


def outcome(events: DataFrame, path: DataFrame, key: Sequence[str]) -> DataFrame:
    """ret from t0 to end (prices at or after both) and its sign as bin."""
    price = path.select(*key, "ts", F.col("price").alias("p1"))
    out = as_of(events, price, key, "end", "ts", ["p1"], "forward").where("p1 is not null")
    ret = (F.col("p1") / F.col("p0") - 1) * F.col("side")
    return out.withColumns({"ret": ret, "bin": F.signum(ret).cast("int")})


def uniqueness(events: DataFrame, bars: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mean of 1 / concurrency over the bars of each event (id, t0, t1): a prefix sum, differenced at the ends."""
    seen = concurrency(events, bars, key, "t0", "t1", "ts").where("n_active > 0")
    w = Window.partitionBy(*key).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    sums = seen.withColumns({"s": F.sum(1 / F.col("n_active")).over(w), "c": F.count(F.lit(1)).over(w)}).select(*key, "ts", "s", "c")
    own = events.columns
    at_end = as_of(events, sums.withColumnsRenamed({"s": "s1", "c": "c1"}), key, "t1", "ts", ["s1", "c1"])
    both = as_of(at_end, sums.withColumnsRenamed({"s": "s0", "c": "c0"}), key, "t0", "ts", ["s0", "c0"], strict=True)
    span = F.col("c1") - F.coalesce("c0", F.lit(0))
    return both.where(span > 0).withColumn("uniqueness", (F.col("s1") - F.coalesce("s0", F.lit(0.0))) / span).select(*own, "uniqueness")


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` plus __i, its place in the global order from 0, and __n, the number of rows.

    Rows are ranged by the whole order and sorted in their partitions, and kept with their place
    there (a second sampling could draw other bounds); only the partitions' counts are summed in one place."""
    placed = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    part, place = F.shiftright("__m", 33).alias("__b"), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("__c"))
    before = counts.select("__b", (F.sum("__c").over(Window.orderBy("__b")) - F.col("__c")).alias("__before"), F.sum("__c").over(Window.partitionBy()).alias("__n"))
    return placed.withColumn("__b", part).join(F.broadcast(before), "__b").withColumn("__i", F.col("__before") + place).drop("__b", "__before", "__m")


def folds(df: DataFrame, order: Sequence[str], count: int, name: str = "fold") -> DataFrame:
    """Contiguous folds in one global order, the first ones a row longer."""
    i, n = F.col("__i"), F.col("__n")
    base, extra = F.floor(n / count), n % count
    fold = F.when(i < extra * (base + 1), F.floor(i / (base + 1))).otherwise(extra + F.floor((i - extra * (base + 1)) / base)).cast("int")
    return numbered(df, order).withColumn(name, fold).drop("__i", "__n")


def embargo(df: DataFrame, order: Sequence[str], rows: int, time: str, name: str = "until") -> DataFrame:
    """The time ``rows`` places later in the global order, the last time near its end."""
    own = numbered(df, order)
    later = own.select((F.col("__i") - rows).alias("__i"), F.col(time).alias("__t"))
    last = df.agg(F.max(time).alias("__m"))
    return own.join(later, "__i", "left").join(F.broadcast(last)).withColumn(name, F.coalesce("__t", "__m")).drop("__i", "__n", "__t", "__m")


def barrier_events(events: DataFrame, path: DataFrame, key: Sequence[str], take: float, stop: float, least: float, side: bool = False, unit: float = 1.0) -> DataFrame:
    """Triple barriers of the events whose target, trgt / unit, exceeds ``least``. Without a side both barriers are ``take`` wide and the side is 1."""
    kept = events.where(F.col("trgt") / unit > least)
    if not side:
        kept, stop = kept.withColumn("side", F.lit(1)), take
    return triple_barrier(kept, path, key, take, stop, unit)


def drop_rare(df: DataFrame, label: str, least: float = 0.05) -> DataFrame:
    """Rows without the rarest labels: the rarest goes while its share of what is left is at most ``least``
    and three labels or more are left (ties go by label). Counts per label are the only ordered rows."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    up = Window.orderBy("__c", label)
    rest = F.sum("__c").over(up.rowsBetween(0, Window.unboundedFollowing))
    left = F.count(F.lit(1)).over(up.rowsBetween(0, Window.unboundedFollowing))
    rare = c.withColumn("__ok", ((F.col("__c") / rest <= least) & (left >= 3)).cast("int"))
    gone = rare.withColumn("__gone", F.min("__ok").over(up.rowsBetween(Window.unboundedPreceding, 0))).where("__gone = 1").select(F.col(label).alias("__l"))
    return df.join(gone, F.col(label).eqNullSafe(F.col("__l")), "left_anti")


def indicator(events: DataFrame, bars: DataFrame, key: Sequence[str]) -> DataFrame:
    """Long form of the indicator matrix: a row for each event and each bar in its span."""
    return in_range(events, bars.select(*key, "ts"), key, "t0", "t1", "ts").select("id", *key, "ts")


def indicator_uniqueness(cells: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mean of 1 / (events on the bar) over each event's bars, from the long form."""
    per = cells.groupBy(*key, "ts").agg(F.count(F.lit(1)).alias("__c"))
    return cells.join(per, [*key, "ts"]).groupBy("id").agg(F.avg(1 / F.col("__c")).alias("uniqueness"))
