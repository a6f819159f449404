"""Per-entity and cross-sectional window expressions. Every function returns a Column."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequential import scan


def along(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def upto(keys, order):
    return along(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def across(keys):
    return Window.partitionBy(*keys)


def first_zero_lag(x: Column, w) -> Column:
    return F.when(F.row_number().over(w) == 1, 0.0).otherwise(F.lag(x).over(w))


def difference(x: Column, w) -> Column:
    return F.when(F.row_number().over(w) == 1, 0.0).otherwise(x - F.lag(x).over(w))


def percent_change(x: Column, w) -> Column:
    return x / F.lag(x).over(w) - 1


def growth(r: Column, running) -> Column:
    """Running product of 1 + r, 0 from a total loss on; a missing r leaves its row missing and doesn't reset."""
    f = 1 + r
    size = F.exp(F.coalesce(F.sum(F.when(f != 0, F.log(F.abs(f)))).over(running), F.lit(0.0)))
    lost, flips = F.count_if(f == 0).over(running) > 0, F.count_if(f < 0).over(running) % 2 == 1
    return F.when(r.isNotNull(), F.when(lost, 0.0).when(flips, -size).otherwise(size))


def price_index(r: Column, running, base: float = 100.0) -> Column:
    return base * growth(r, running)


def rolling(fn, x: Column, w, n: int) -> Column:
    """``fn`` over the last n rows, missing until n values are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, fn(x).over(frame))


def forward_fill(x: Column, running) -> Column:
    return F.last(x, ignorenulls=True).over(running)


def backward_fill(x: Column, w) -> Column:
    return F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def rank_scaled(x: Column, keys) -> Column:
    """Dense rank scaled to [-1, 1] within keys; 0 for a constant column or a missing value.

    A value's ranks from below and from above together give the number of distinct values."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(x.asc_nulls_first())) - 1
    above = F.dense_rank().over(Window.partitionBy(*keys).orderBy(x.desc_nulls_last())) - 1
    base = F.max(F.when(x.isNull(), 1).otherwise(0)).over(across(keys))
    top = rank + above - base
    return F.when(x.isNull() | (top <= 0), 0.0).otherwise((rank - base) / top * 2 - 1)


def average_rank(x: Column, keys) -> Column:
    own = Window.partitionBy(*keys, x)
    return F.rank().over(Window.partitionBy(*keys).orderBy(x)) + (F.count(F.lit(1)).over(own) - 1) / 2


def decile(x: Column, keys) -> Column:
    return F.floor(average_rank(x, keys) * 10 / (F.count(x).over(across(keys)) + 1)).cast("int")


def zscore(x: Column, keys) -> Column:
    sd = F.stddev_pop(x).over(across(keys))
    return F.when(sd < 1e-12, 0.0).otherwise((x - F.avg(x).over(across(keys))) / sd)


def min_max(x: Column, keys) -> Column:
    low, high = F.min(x).over(across(keys)), F.max(x).over(across(keys))
    return F.when(high == low, 0.0).otherwise((x - low) / (high - low))


def fill_median(df: DataFrame, x: str, keys: Sequence[str]) -> DataFrame:
    """``df`` with missing ``x`` filled by the median of its keys: value counts are merged before the shuffle, and joined back."""
    names = [f"__k{i}" for i in range(len(keys))]
    middle = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.median(x).alias("__m"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    return df.join(middle, same, "left").withColumn(x, F.coalesce(x, "__m")).drop("__m", *names)


def signed_sum(signs: dict[str, int], columns: Sequence[str] | None = None) -> Column:
    """Signed sum of columns, missing as soon as one member's value is; with ``columns`` given, members
    that aren't among them are skipped with a warning."""
    absent = [c for c in signs if columns is not None and c not in columns]
    if absent:
        warnings.warn(f"no columns {', '.join(absent)}", stacklevel=2)
    terms = [F.col(name) * F.lit(float(sign)) for name, sign in signs.items() if name not in absent]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def ewm(df: DataFrame, keys: Sequence[str], order: str, x: str, span: float) -> DataFrame:
    """Exponentially weighted mean (adjusted, and recursive) and debiased standard deviation per row.

    Missing values get no weight but age those before them; their rows carry the last figures."""
    a = 2.0 / (span + 1)
    f = 1 - a

    def step(state, xs):
        total, squares, mean, spread, recursive, age = state or (0.0, 0.0, 0.0, 0.0, None, 1.0)
        means, recursives, sds = [], [], []
        for v in xs:
            total, squares, spread, age = total * f, squares * f * f, spread * f, age * f
            if v == v:
                total, squares = total + 1, squares + 1
                gap = v - mean
                mean += gap / total
                spread += gap * (v - mean)
                recursive = v if recursive is None else (age * recursive + a * v) / (age + a)
                age = 1.0
            bias = total * total - squares
            means.append(mean if total > 0 else None)
            recursives.append(recursive)
            sds.append((spread * total / bias) ** 0.5 if bias > 1e-12 * total * total and total > 0 else None)
        return (total, squares, mean, spread, recursive, age), range(len(xs)), means, recursives, sds

    t = df.select(*keys, order, F.col(x).cast("double").alias(x))
    return scan(t, keys, [order], [x], step, [*keys, order], "ewm_mean double, ewm_recursive double, ewm_std double")
