"""Exact n-gram Jaccard join with count-vector R-trees.

A document is the set of its distinct word shingles (hashed to 64 bits). Texts with equal
sets form a class, and all further work is on classes, so copies cost nothing.

1. Cells. Two sets that link differ in at most ``k`` shingles, where ``k`` follows from the
   smaller set's size. Shingles are hashed into groups, so many that some group holds the
   same shingles in both sets: its contents name a cell that both lie in (see ``Bands``; a
   set with too few groups that count is grouped again with another seed, as any partner
   with the same trouble is). Cells are combined before the
   shuffle, so that a cell shared by very many sets arrives as few rows, and each cell gives
   edges from its sets to its smallest one. Connected, these edges split the sets into
   clusters, outside of which no link can be.
2. R-trees. In a cluster every set is a point, its shingle counts in ``DIMS`` hashed groups.
   Points are packed into leaves; the overlap of a set with anything in a leaf is at most
   the sum of coordinate minima with the leaf's upper corner, that with a point the sum of
   minima with the point. What survives is verified on the shingles. A leaf or point that
   is already connected with the set is passed over: components stay the same, and a group
   of near copies costs about one check each. Large clusters are cut into blocks by size
   and hash, and every two blocks whose sizes allow a link are joined in a task of their own.
3. Links are connected to components.

Defined results: null or wordless text has an empty set and links with nothing; a text with
fewer words than a shingle is one shingle, its whole sequence; a null doc_id is reported
with the component of its class (null if no doc_id is in it); repeated rows are in one
class; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, per_slice, release, slices, table
from .components import combined, components, forest, packed
from .decontaminate import WordHashes

#: Coordinates of a point, points in a leaf, cells held before they are combined and sent on, shingles in a block.
DIMS, LEAF, BUFFER_CELLS, BLOCK_SHINGLES = 64, 32, 400_000, 1_500_000
_A, _B, _ALL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text's word hashes."""
    if len(h) == 0:
        return h
    if len(h) < n:
        return _mix(np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = _mix(out ^ h[i : len(h) - n + 1 + i]) + np.uint64(i)
    return np.unique(out)


class Sets:
    """Shingle sets of texts, word hashes found once per distinct word."""

    def __init__(self, n: int):
        self.n, self.hashes = n, WordHashes(120_000)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        lists = [t.encode().lower().split() if t else [] for t in texts]
        flat = self.hashes([w for x in lists for w in x])
        ends = np.cumsum([0, *map(len, lists)])
        return [shingle_set(flat[a:b], self.n) for a, b in zip(ends, ends[1:], strict=False)]


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class Bands:
    """Sizes in bands; per band the number of groups and which of them name cells.

    A link in a band has at most ``k`` differing shingles. Small sets: more than ``k`` groups of a
    seed are filled, so one at least is the same in both. Sets from ``SMALL`` on: a group is the
    same in both with a chance of ``exp(-k / groups)`` or more, whatever the sets, and so many
    groups are named that all of them differ with a chance under ``exp(-NATS)``, as rare as two
    hashes that collide (where more than ``k`` groups are few and well filled, they are used
    there too). Groups of fewer than ``least_held`` shingles are passed over there, since
    sets that share a sentence would meet in them."""

    SIGMAS, SMALL, NATS, MOST = 3.0, 96, 34.0, 96

    def __init__(self, percent: int):
        self.percent = percent
        self.ratio = min(1.4, 0.8 * percent / max(1, 100 - percent))
        if self.ratio < 1.15:
            raise ValueError("the cells need a threshold of 60 percent or more")
        self.least = next(n for n in range(1, 1 << 20) if 100 * n >= percent * (n + 1))
        self.tops = [self.least - 1]
        self.known: dict[int, tuple[int, int, int, int]] = {}

    def band(self, n: int) -> int:
        while self.tops[-1] < n:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * self.ratio)))
        return int(np.searchsorted(self.tops, n))

    def groups(self, band: int) -> tuple[int, int, int, int]:
        """Cells that a set needs, groups, groups that may name a cell, shingles that one must hold."""
        if band not in self.known:
            k, n = (100 - self.percent) * self.tops[band] // self.percent, self.tops[band - 1] + 1
            g, need = k + 1, min(self.MOST, n // 2)

            def filled(g: int) -> float:
                some, both = (1 - 1 / g) ** n, (1 - 2 / g) ** n if g > 1 else 0.0
                spread = g * some + g * (g - 1) * both - (g * some) ** 2
                return g - g * some - self.SIGMAS * max(0.0, spread) ** 0.5

            while filled(g) <= k and g < 4 * (k + 2):
                g += 1 + g // 200
            self.known[band] = (k + 1, g, g, 1)
            if n >= self.SMALL and (g > need or n < 3.5 * g):
                g = math.ceil(k / -math.log(1 - math.exp(-self.NATS / need)))
                held = 1 if n < 2 * g else 2 if n < 6 * g else 3
                share = 1 - sum(math.exp(-n / g) * (n / g) ** i / math.factorial(i) for i in range(held))
                self.known[band] = (need, g, min(g, math.ceil(1.15 * need / share)), held)
        return self.known[band]

    def of(self, n: int) -> list[int]:
        """Bands in which a set of this size is filed: its own, and those of the smaller sets it may link with."""
        return list(range(self.band(max(self.least, -(-self.percent * n // 100))), self.band(n) + 1))

    def cells(self, s: np.ndarray) -> np.ndarray:
        """Cell hashes of a set: per band those of one seed after the other, until it has the cells that it needs."""
        out = []
        for band in self.of(len(s)) if len(s) >= self.least else ():
            need, g, used, held = self.groups(band)
            k = (100 - self.percent) * self.tops[band] // self.percent
            small, got = need == k + 1 and used == g, 0
            for seed in itertools.count(1):
                mixed = _mix(s + np.uint64(int(_A) * seed & _ALL))
                group = ((mixed >> np.uint64(32)) * np.uint64(g)) >> np.uint64(32)
                if used < g:
                    keep = group < used
                    mixed, group = mixed[keep], group[keep]
                order = np.argsort(group, kind="stable")
                first = np.flatnonzero(np.diff(group[order], prepend=np.uint64(g + 1)))
                if len(first):
                    total = np.add.reduceat(mixed[order] * _B, first)
                    tag = _mix(np.array([band << 32 | seed], np.uint64))
                    named = np.diff(first, append=len(group)) >= held
                    out.append(_mix(total ^ _mix(group[order][first] + tag))[named])
                    got = (0 if small else got) + int(named.sum())
                if got >= need:
                    break
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _members(n: int):
    sets: list[Sets] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not sets:
            sets.append(Sets(n))
        got = sets[0](batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, got), pa.int64()), pa.array((class_of(s) if len(s) else None for s in got), pa.int64())], ["doc_id", "n_shingles", "class"])

    return run


def _send_cells(n: int, percent: int, parts: int):
    """Per part and buffer: the classes filed in it, how many cells each has there, and these cells.

    Classes of a buffer that share cells are connected there and then, and their cells go on
    under the smallest of them: a large group of near copies is one class a buffer."""

    def run(batches):
        sets, bands = Sets(n), Bands(percent)
        held: dict[int, np.ndarray] = {}
        size = 0

        def flush():
            classes = np.array(list(held), np.int64)
            cells = np.concatenate(list(held.values()))
            owner = np.repeat(classes, [len(c) for c in held.values()])
            order = np.lexsort((owner, cells))
            cells, owner = cells[order], owner[order]
            first = np.flatnonzero(np.diff(cells, prepend=~cells[:1]))
            hub = np.repeat(owner[first], np.diff(first, append=len(cells)))
            edges = forest(np.stack([owner, hub], 1)[owner != hub])
            cells, owner = cells[first], owner[first]
            if len(edges):
                at = np.minimum(np.searchsorted(edges[:, 0], owner), len(edges) - 1)
                owner = np.where(edges[at, 0] == owner, edges[at, 1], owner)
            part = (cells >> np.uint64(40)) % np.uint64(parts)
            order = np.lexsort((owner, part))
            cells, owner, part = cells[order], owner[order], part[order]
            rows: list[tuple] = [(int(i % parts), None, None, None, edges[i : i + 100_000].tobytes()) for i in range(0, len(edges), 100_000)]
            cut = np.flatnonzero(np.diff(part, prepend=np.uint64(parts)))
            for a, b in zip(cut, [*cut[1:], len(part)], strict=True):
                own, counts = np.unique(owner[a:b], return_counts=True)
                rows.append((int(part[a]), own.tobytes(), counts.astype(np.uint32).tobytes(), cells[a:b].tobytes(), None))
            held.clear()
            names = ["part", "classes", "counts", "cells", "edges"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "part" else pa.binary()) for k, c in zip(names, zip(*rows, strict=True), strict=True)], names)

        for batch in batches:
            for piece in slices(batch, "text"):
                for s in sets(piece.column("text").to_pylist()):
                    if len(s) >= bands.least and (c := class_of(s)) not in held:
                        held[c] = bands.cells(s)
                        size += len(held[c])
                if size > BUFFER_CELLS:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        sets = None
        release()

    return run


def _meet(buckets: int):
    """Edges from the classes that share cells to the smallest that they reach here, packed by class."""

    def run(batches):
        cells, owner, edges = [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["cells"] is not None:
                    cells.append(np.frombuffer(row["cells"], np.uint64))
                    owner.append(np.repeat(np.frombuffer(row["classes"], np.int64), np.frombuffer(row["counts"], np.uint32)))
                else:
                    edges.append(np.frombuffer(row["edges"], np.int64).reshape(-1, 2))
        if cells:
            c, o = np.concatenate(cells), np.concatenate(owner)
            cells.clear(), owner.clear()
            order = np.lexsort((o, c))
            c, o = c[order], o[order]
            first = np.flatnonzero(np.diff(c, prepend=~c[:1]))
            hub = np.repeat(o[first], np.diff(first, append=len(c)))
            edges.append(np.stack([o, hub], 1)[o != hub])
        if edges:
            yield from packed(forest(np.concatenate(edges)), buckets)
        cells = owner = edges = c = o = order = first = hub = None
        release()

    return run


class RTree:
    """Count vectors packed into leaves: by size, then by the coordinate of largest spread within a run of sizes."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        run = LEAF * LEAF
        for a in range(0, len(order), run):
            part = order[a : a + run]
            order[a : a + run] = part[np.argsort(points[part, int(np.argmax(points[part].std(0)))], kind="stable")]
        self.order, self.cut = order, np.arange(0, len(order), LEAF)
        self.high = np.maximum.reduceat(points[order], self.cut)
        self.smallest = np.minimum.reduceat(sizes[order], self.cut)
        self.sizes, self.points = sizes, points

    def near(self, q: np.ndarray, n: int, percent: int, root: np.ndarray, own: int) -> np.ndarray:
        """Points whose overlap bound allows a link with a set of ``n`` and which aren't yet in its component."""

        def allowed(bound: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            both = np.minimum(bound, np.minimum(n, np.maximum(sizes, bound)))
            return (100 + percent) * both >= percent * (n + np.maximum(sizes, both))

        apart = np.add.reduceat((root[self.order] != own).astype(np.int64), self.cut) > 0
        leaves = np.flatnonzero(apart & allowed(np.minimum(self.high, q).sum(1), self.smallest))
        if not len(leaves):
            return leaves
        at = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        at = self.order[at[at < len(self.order)]]
        at = at[root[at] != own]
        return at[allowed(np.minimum(self.points[at], q).sum(1), self.sizes[at])]


def link(classes: np.ndarray, sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect the sets' components (a spanning forest); with ``side`` only links across sides are sought."""
    sizes = np.array([len(s) for s in sets], np.int64)
    local, flat = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(sizes) - sizes
    group = (_mix(local) >> np.uint64(32)) % np.uint64(DIMS)
    points = np.zeros((len(sets), DIMS), np.int32)
    np.add.at(points, (np.repeat(np.arange(len(sets)), sizes), group[flat].astype(np.int64)), 1)
    tree = RTree(sizes, points)
    root, inside, out = np.arange(len(sets)), np.zeros(len(local), bool), []
    for x in np.argsort(-sizes, kind="stable"):
        near = tree.near(points[x], int(sizes[x]), percent, root, root[x])
        near = near[near != x]
        if side is not None:
            near = near[side[near] != side[x]]
        if not len(near):
            continue
        inside[flat[start[x] : start[x] + sizes[x]]] = True
        n = sizes[near]
        at = np.repeat(start[near] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.add.reduceat(inside[flat[at]].astype(np.int64), np.cumsum(n) - n)
        inside[flat[start[x] : start[x] + sizes[x]]] = False
        for y in near[100 * both >= percent * (n + sizes[x] - both)]:
            if root[y] != root[x]:
                out.append((int(classes[x]), int(classes[y])))
                root[root == root[y]] = root[x]
    return out


def _link_task(percent: int, n: int):
    def run(group: pa.Table) -> pa.Table:
        seen: dict[int, tuple[np.ndarray, int]] = {}
        sets = Sets(n)
        for batch in group.to_batches():
            for piece in slices(batch, "text"):
                for c, s, side in zip(piece.column("class").to_pylist(), sets(piece.column("text").to_pylist()), piece.column("side").to_pylist(), strict=True):
                    if len(s) and class_of(s) == c:
                        seen[c] = (s, side)
        across = len({side for _, side in seen.values()}) > 1
        found = link(np.array(list(seen), np.int64), [s for s, _ in seen.values()], percent, np.array([b for _, b in seen.values()]) if across else None) if len(seen) > 1 else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _tasks(classes: DataFrame, percent: int) -> DataFrame:
    """``classes`` (class, cluster, n_shingles) plus the tasks each is in: structs of name and side.

    A cluster within BLOCK_SHINGLES is one task. A larger one is cut by size band and, where
    a band is large, by hash; tasks are then pairs of blocks of one band or of neighbours."""
    widths = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100 / percent * 1.0001))).cast("int")
    banded = classes.withColumn("band", widths)
    per_band = banded.groupBy("cluster", "band").agg(F.sum("n_shingles").alias("n"))
    total = per_band.groupBy("cluster").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("n") / BLOCK_SHINGLES).cast("int").alias("n")))).alias("blocks"))
    at = lambda d: F.coalesce(F.element_at("blocks", F.col("band") + d), F.lit(0))
    h = F.pmod(F.xxhash64("class"), at(0)).cast("int")

    def name(low, a, high, b):
        return F.concat_ws("/", low.cast("string"), a.cast("string"), high.cast("string"), b.cast("string"))

    def each(d, make):
        return F.when(at(d) > 0, F.transform(F.sequence(F.lit(0), at(d) - 1), make)).otherwise(F.array().cast("array<struct<task:string,side:int>>"))

    s = lambda task, side: F.struct(task.alias("task"), side.cast("int").alias("side"))
    band = F.col("band")
    same = each(0, lambda x: s(name(band, F.least(h, x), band, F.greatest(h, x)), F.when(h <= x, 0).otherwise(1)))
    up = each(1, lambda x: s(name(band, h, band + 1, x), F.lit(0)))
    down = each(-1, lambda x: s(name(band - 1, x, band, h), F.lit(1)))
    one = F.array(s(F.lit("all"), F.lit(0)))
    return banded.join(total, "cluster").select("class", "cluster", F.when(F.col("total") <= BLOCK_SHINGLES, one).otherwise(F.concat(same, up, down)).alias("tasks"))


def join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: Jaccard of word shingles at least ``percent`` / 100."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    members = durable(docs.mapInArrow(per_slice(_members(words)), "doc_id bigint, n_shingles bigint, class bigint"))
    classes = members.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"))
    shingles = members.agg(F.sum("n_shingles")).first()[0] or 0
    parts = int(max(16, shingles // 2_000_000))
    sent = docs.mapInArrow(_send_cells(words, percent, parts), "part int, classes binary, counts binary, cells binary, edges binary")
    buckets = max(16, parts // 100)
    met = sent.repartition(parts, "part").mapInArrow(_meet(buckets), "bucket int, edges binary")
    clusters = durable(components(combined(met, buckets)).withColumnsRenamed({"node": "class", "component": "cluster"}))
    filed = _tasks(clusters.join(classes.where("rep is not null"), "class").select("class", "cluster", "n_shingles"), percent)
    chosen = filed.join(classes.select("class", "rep"), "class")
    texts = chosen.join(docs, F.col("rep") == F.col("doc_id")).select("class", "cluster", "tasks", "text")
    placed = texts.select("class", "cluster", "text", F.explode("tasks").alias("t")).select("class", "cluster", "text", "t.*")
    links = placed.groupBy("cluster", "task").applyInArrow(_link_task(percent, words), "a bigint, b bigint")
    joined = components(links).withColumnsRenamed({"node": "class"})
    lowest = classes.join(joined, "class", "left").select("class", "rep", F.coalesce("component", "class").alias("component"))
    smallest = lowest.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = lowest.join(smallest, "component").select("class", "component_id")
    return members.join(named, "class", "left").select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def apply(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, that with the smallest doc_id; documents without doc_id stay."""
    kept = join(docs, words, percent).where("doc_id = component_id").select("doc_id").distinct()
    one = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.union(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), words=4, percent=85)


def oracle() -> str:
    """The same in DuckDB SQL, every two sets that share a shingle compared."""
    return r"""
with recursive d as (select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct rid, doc_id, array_to_string(w[i:i + 3], ' ') as s from (select rid, doc_id, w, unnest(range(1, cast(greatest(len(w) - 2, 2) as bigint))) as i from d where len(w) > 0)),
n as (select rid, doc_id, count(*) as n from s group by rid, doc_id),
p as (select x.rid as a, y.rid as b, count(*) as c from s x join s y on x.s = y.s and x.rid < y.rid group by 1, 2),
e as (select a, b from p join n na on na.rid = a join n nb on nb.rid = b where 100 * c >= 85 * (na.n + nb.n - c)),
u as (select a, b from e union select b, a from e),
r(a, b) as (select rid, rid from d union select r.a, u.b from r join u on u.a = r.b)
select d.doc_id, cast(coalesce(any_value(n.n), 0) as bigint) as n_shingles, min(t.doc_id) as component_id
from d left join n using (rid) join r on r.a = d.rid join d t on t.rid = r.b group by d.rid, d.doc_id"""
