"""Missing values from nearest rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed column by column as SQL does."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        out += (x[:, None] - y[None, :]) ** 2
    return out


def _leaves(x: np.ndarray, size: int = 64) -> list[np.ndarray]:
    """Rows of ``x`` in boxes of ``size`` at most, halved along their widest side."""
    todo, out = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        own = x[at]
        half = len(at) // 2
        at = at[np.argpartition(own[:, np.ptp(own, axis=0).argmax()], half)]
        todo += [at[:half], at[half:]]
    return out


def _least(row: np.ndarray, to: np.ndarray, gap: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least of each row by (gap, to)."""
    order = np.lexsort((to, gap, row))
    row, to, gap = row[order], to[order], gap[order]
    first = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1, [len(row)]])
    place = np.arange(len(row)) - np.repeat(first[:-1], np.diff(first)) if len(row) else row
    return row[place < k], to[place < k], gap[place < k]


def nearest(query: np.ndarray, given: np.ndarray, k: int, wide: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``query``, row of ``given``, squared distance) of the k nearest given rows, ties to the earlier one.

    Boxes of queries meet only the boxes of given rows that can hold one of the k: a box's least distance is
    rounded like its rows' and so never above theirs. Of equal rows only the first k are looked at."""
    if not len(query) or not len(given):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    order = np.lexsort(given.T)
    same = np.concatenate([[False], (given[order][1:] == given[order][:-1]).all(1)])
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    pool = np.sort(order[np.arange(len(order)) - start < k])
    boxes = [pool[b] for b in _leaves(given[pool])]
    low, high = np.stack([given[b].min(0) for b in boxes]), np.stack([given[b].max(0) for b in boxes])
    found = []
    for q in _leaves(query):
        x = query[q]
        apart = np.maximum(np.maximum(low - x.max(0), x.min(0) - high), 0)
        bound = np.zeros(len(boxes))
        for side in apart.T:
            bound += side**2
        near = np.argsort(bound, kind="stable")
        reach, close = np.inf, np.concatenate([boxes[b] for b in near[: 4 + k // 8]])
        if len(close) >= k:
            reach = np.partition(_distance(x, given[close]), k - 1, axis=1)[:, k - 1].max()
        close = np.concatenate([boxes[b] for b in near[: np.searchsorted(bound[near], reach, side="right")]])
        best = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        for at in range(0, len(close), wide):
            part = close[at : at + wide]
            d = _distance(x, given[part])
            cut = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if len(part) > k else np.inf
            r, c = np.nonzero(d <= cut)
            best = _least(*(np.concatenate(z) for z in zip(best, (r, part[c], d[r, c]), strict=True)), k)
        found.append((q[best[0]], best[1], best[2]))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def impute(df: DataFrame, keys: Sequence[str], id: str, column: str, near: Sequence[str], k: int = 5, block: int = 1 << 18) -> DataFrame:
    """``df`` with missing values of one column filled by the mean of the k nearest rows of the same keys that have it.

    The distance is Euclidean over the columns that both rows have, scaled up for those they lack; rows
    without a common column are no neighbours, ties go to the smaller id. Rows with a hole and the others of
    their keys meet in blocks of about ``block`` rows a side, searched by boxes; a block gives k rows for each hole."""
    keys, near = list(keys), list(near)
    hole = F.col(column).isNull()
    sizes = df.groupBy(*keys).agg(*[F.greatest(F.lit(1), F.ceil(F.count_if(h) / block)).cast("int").alias(n) for h, n in ((hole, "__m"), (~hole, "__n"))])
    sized = df.select(*keys, id, column, *near).join(F.broadcast(sizes), keys)
    deal = lambda n: F.pmod(F.xxhash64(id), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    double = [F.col(c).cast("double").alias(c) for c in near]
    gaps = sized.where(hole).select(*[F.col(c).alias(f"__{c}") for c in keys], F.col(id).alias("__id"), *double, deal("__m").alias("__g"), each("__n").alias("__b"))
    given = sized.where(~hole).select(*keys, id, column, *double, deal("__n").alias("__b"), each("__m").alias("__g"))
    kinds = dict(df.dtypes)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(id, kind="stable").reset_index(drop=True)
        x, y = a[near].to_numpy(float), b[near].to_numpy(float)
        has, have = ~np.isnan(x), ~np.isnan(y)
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for p in np.unique(has, axis=0):
            for q in np.unique(have, axis=0):
                both = np.flatnonzero(p & q)
                if not len(both):
                    continue
                i, j = np.flatnonzero((has == p).all(1)), np.flatnonzero((have == q).all(1))
                r, c, d = nearest(x[np.ix_(i, both)], y[np.ix_(j, both)], k)
                found.append((i[r], j[c], d if len(both) == len(near) else d * len(near) / len(both)))
        r, c, d = _least(*(np.concatenate(z) for z in zip(*found, strict=True)), k)
        own = a[[*(f"__{c}" for c in keys), "__id"]].iloc[r].reset_index(drop=True)
        return own.set_axis([*keys, "__id"], axis=1).assign(**{"__to": b[id].to_numpy()[c], "__v": b[column].to_numpy()[c], "__d": d})

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), f"__id {kinds[id]}", f"__to {kinds[id]}", f"__v {kinds[column]}", "__d double"])
    ours, theirs = gaps.groupBy(*[f"__{c}" for c in keys], "__g", "__b"), given.groupBy(*keys, "__g", "__b")
    pairs = ours.cogroup(theirs).applyInPandas(run, schema)
    rank = F.row_number().over(Window.partitionBy(*keys, "__id").orderBy("__d", "__to"))
    found = pairs.withColumn("__r", rank).where(F.col("__r") <= k).groupBy(*keys, F.col("__id").alias(id)).agg(F.avg("__v").alias("__v"))
    return df.join(found, [*keys, id], "left").withColumn(column, F.coalesce(column, "__v")).drop("__v")
