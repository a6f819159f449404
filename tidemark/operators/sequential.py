"""Passes over sorted rows that carry a state from one row to the next."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame


def scan(df: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str], step: Callable, keep: Sequence[str], adds: str) -> DataFrame:
    """Rows of ``df`` in order within each key, a batch at a time, with a state that goes along.

    ``step(state, *lists)`` gets the values of one key's next rows (state None at the key's first)
    and returns (state, places, *more): the places of the rows to keep, and a list for each column
    of ``adds``. Rows are hashed by key and sorted on disk if need be, so a worker holds one Arrow
    batch and one state, however long a key's history is."""
    import numpy as np
    import pandas as pd

    key, order, values, keep = list(key), list(order), list(values), list(keep)
    names = list(dict.fromkeys([*key, *order, *values, *keep]))
    fresh = [part.split()[0] for part in adds.split(",")] if adds else []

    def run(batches):
        held, state = None, None
        for b in batches:
            if not len(b):
                continue
            start = np.zeros(len(b), bool)
            start[0] = True
            for k in key:
                col, gone = b[k], b[k].isna()
                start |= ((col != col.shift()) & ~(gone & gone.shift(fill_value=False))).to_numpy()
            cuts = [*np.flatnonzero(start).tolist(), len(b)]
            lists = [b[v].tolist() for v in values]
            keys = [[None if x != x else x for x in b[k].tolist()] for k in key]
            at, more = [], [[] for _ in fresh]
            for i, j in zip(cuts, cuts[1:], strict=False):
                own = [k[i] for k in keys]
                if own != held:
                    held, state = own, None
                state, places, *extra = step(state, *(x[i:j] for x in lists))
                at.extend(i + p for p in places)
                for column, x in zip(more, extra, strict=True):
                    column.extend(x)
            if not at:
                continue
            out = b[keep].iloc[at].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(dict(zip(fresh, more, strict=True)))], axis=1) if fresh else out

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + ([adds] if adds else []))
    return df.select(*names).repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)
