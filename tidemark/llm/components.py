"""Connected components of an edge table: local forests and steps of neighbours to their minimum.

A task replaces the edges it holds by a spanning forest of stars (in buffers of
``BUFFER_EDGES``). ``packed`` and ``combined`` do so before the first round too, around
shuffles in which a node's edges come as bytes to one task. A round takes each node's smallest neighbour ``m``, combined before
the shuffle, and joins it back to the node's edges, so that all its neighbours hang on ``m``;
the minima are written first and nothing after the join relies on where a row is, so that the
engine may split a node with very many edges over tasks. Rounds end when all edges are stars.

Defined results: an empty table gives an empty one; loops and nulls are ignored, a node with
nothing else isn't reported; repeated edges count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Edges that a task holds at once.
BUFFER_EDGES = 1_000_000


def forest(edges: np.ndarray) -> np.ndarray:
    """(node, smallest node of its component) for all other nodes of the edges (n x 2)."""
    nodes, at = np.unique(edges, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    return np.stack([nodes[own], nodes[root[own]]], 1)


def batches_of(edges: np.ndarray, names: tuple[str, str]):
    for i in range(0, len(edges), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(edges[i : i + 50_000, 0]), pa.array(edges[i : i + 50_000, 1])], list(names))


def _forests(arrays):
    """Forests of the edges that come in arrays, a buffer at a time."""
    held, size = [], 0
    for x in arrays:
        held.append(x)
        size += len(x)
        if size > BUFFER_EDGES:
            yield forest(np.concatenate(held))
            held, size = [], 0
    if size:
        yield forest(np.concatenate(held))


def _moved(batches):
    """Edges (u, v), as forests, of rows (u, v, m): both ends hang on ``m``."""
    ends = ([b.column(c).to_numpy() for c in ("u", "v", "m")] for b in batches)
    for f in _forests(np.concatenate([np.stack([u, m], 1), np.stack([v, m], 1)]) for u, v, m in ends):
        yield from batches_of(f, ("u", "v"))


def packed(edges: np.ndarray, buckets: int):
    """Rows of a bucket and its edges as bytes, dealt out by node (of a forest: one edge a node)."""
    at = ((edges[:, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
    order = np.argsort(at, kind="stable")
    edges, at = edges[order], at[order]
    cut = np.flatnonzero(np.diff(at, prepend=-1))
    blobs = [edges[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(at)), strict=False)]
    for i in range(0, len(blobs), 1000):
        yield pa.RecordBatch.from_arrays([pa.array(at[cut[i : i + 1000]], pa.int32()), pa.array(blobs[i : i + 1000], pa.binary())], ["bucket", "edges"])


def _blobs(batches):
    for batch in batches:
        for blob in batch.column("edges"):
            yield np.frombuffer(blob.as_buffer(), np.int64).reshape(-1, 2)


def combined(rows: DataFrame, buckets: int) -> DataFrame:
    """Edges (u, v) of packed rows after two shuffles by node: few are left of what many tasks found alike."""

    def again(batches):
        for f in _forests(_blobs(batches)):
            yield from packed(f, buckets)

    def last(batches):
        for f in _forests(_blobs(batches)):
            yield from batches_of(f, ("u", "v"))

    once = rows.repartition(buckets, "bucket").mapInArrow(again, "bucket int, edges binary")
    return once.repartition(buckets, "bucket").mapInArrow(last, "u bigint, v bigint")


def _all_stars(e: DataFrame) -> bool:
    ends = e.select(F.col("u").alias("node"), "v").union(e.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v")))
    seen = ends.groupBy("node").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.col("v").isNull()).alias("root"))
    return seen.where("low <> high or (low is not null and root)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for every node of ``edges`` (two long columns)."""
    e = durable(edges.toDF("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while not _all_stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        e = durable(both.join(low, "u").select("u", "v", "m").mapInArrow(_moved, "u bigint, v bigint"))
    stars = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), "component").union(roots)
