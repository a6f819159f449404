"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words at a mask's kept places; the ignored places may differ.
Each training text's seeds are looked up among those of the benchmark items (the hash join;
the items are sent out in blocks of bounded size, one pass over the texts a block, so any
number of items is handled whole). Around a hit the text and the item are laid over each
other on the hit's diagonal, and where enough words are equal the best stretch is found in
which a differing word costs twice what an equal one gains. The overlap counts if at least ``MATCHED`` words of the
stretch are equal, or ``SHARE`` of a shorter item's words. Every overlap that counts holds
a seed of ``LIGHT``: in its first ``MATCHED`` equal words at most half as many differ, and
the tests go through all such patterns.

An item under ``SHORTEST`` words counts only where it makes up a whole line of the text, word
for word: inside a sentence so few words tell nothing.

Defined results: null texts and items count as empty and match nothing, as do items without
words; words are lower-cased runs of letters and digits; repeated documents give repeated
results, repeated items one result each; ties between stretches, and between lines, go to the
earliest; other columns stay in ``apply`` and are ignored by ``find``; an empty table gives an
empty one, an empty benchmark finds nothing.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Codes, per_slice, table

#: Kept places of the masks that are searched.
LIGHT = ((0, 1, 2, 4), (0, 1, 2, 3), (0, 1, 3, 4))
#: Longer masks, with fewer hits by chance; alone they miss overlaps.
MASKS = ((0, 1, 2, 4, 7, 8, 10, 11), (0, 1, 3, 4, 5, 8, 9, 11), (0, 2, 3, 5, 6, 7, 10, 11))
MATCHED, SHARE, SHORTEST = 13, 0.8, 5
#: Words of the items that one pass sends to every executor, at most (one longer item goes alone).
BLOCK_WORDS = 2_000_000
#: Hits of seeds that are expanded at once.
HITS = 1 << 20
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes:
    """64-bit hashes of words, each distinct word hashed once; emptied when it grows past ``limit``."""

    def __init__(self, limit: int = 250_000):
        self.limit, self.codes, self.hashes = limit, Codes(), np.zeros(0, np.uint64)

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.codes) > self.limit:
            self.codes, self.hashes = Codes(), np.zeros(0, np.uint64)
        code = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        if len(self.codes) > len(self.hashes):
            new = list(self.codes)[len(self.hashes) :]
            self.hashes = np.concatenate([self.hashes, np.fromiter((xxhash.xxh3_64_intdigest(w) for w in new), np.uint64, len(new))])
        return self.hashes[code]


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def seeds(h: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """Seed of the mask at every place where it fits."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt + 1, np.uint64)
    for at in mask:
        out = (out ^ h[at : at + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out


class Items:
    """A block of benchmark items with an index of their seeds."""

    def __init__(self, rows: list[tuple[int, str | None]], masks: tuple[tuple[int, ...], ...] = MASKS):
        hashes = WordHashes()
        self.ids, self.words, self.masks = [], [], list(masks)
        self.short: dict[tuple[str, ...], list[int]] = {}
        for i, text in rows:
            w = tokens(text)
            if 0 < len(w) < SHORTEST:
                self.short.setdefault(tuple(w), []).append(i)
            elif w:
                self.ids.append(i)
                self.words.append(hashes(w))
        self.sizes = np.array([len(w) for w in self.words], int)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.uint64)
        self.least = np.array([min(MATCHED, math.ceil(SHARE * n)) for n in self.sizes], int)
        keys, item, place = [], [], []
        for m, mask in enumerate(self.masks):
            for k, w in enumerate(self.words):
                if len(w) > mask[-1]:
                    s = seeds(w, mask, m)
                    keys.append(s)
                    item.append(np.full(len(s), k))
                    place.append(np.arange(len(s)))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, int)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, int)
        self.bits = np.zeros(1 << max(16, int(len(self.keys)).bit_length() + 4), bool)
        self.low = np.uint64(len(self.bits) - 1)
        self.bits[self.keys & self.low] = True

    def laid(self, h: np.ndarray, most: int = HITS) -> np.ndarray:
        """Distinct items and the places of ``h`` (or before it) that they start from, over every seed in common.

        Hits are expanded ``most`` at a time and put together by diagonal, so that what is held
        is never more than the items laid at every place of the text."""
        out = np.zeros((2, 0), np.int64)
        for m, mask in enumerate(self.masks):
            s = seeds(h, mask, m)
            at = np.flatnonzero(self.bits[s & self.low])
            lo, hi = np.searchsorted(self.keys, s[at]), np.searchsorted(self.keys, s[at], side="right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            cuts = np.unique(np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), most), side="right")) if len(n) else []
            for a, b in zip(cuts, [*cuts[1:], len(n)], strict=True) if len(n) else ():
                c = n[a:b]
                k = np.repeat(lo[a:b] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                out = np.unique(np.concatenate([out, np.stack([self.item[k], np.repeat(at[a:b], c) - self.place[k]])], 1), axis=1)
        return out

    def lines(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """Per short item that is a line of the text: its words, first and last place (past it)."""
        out: dict[int, tuple[int, int, int]] = {}
        done = 0
        for line in text.split("\n") if text and self.short else ():
            w = tuple(tokens(line))
            for i in self.short.get(w, ()):
                out.setdefault(i, (len(w), done, done + len(w)))
            done += len(w)
        return out


def stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """Best run of +1 for equal and -2 for differing words: start, end, equal words in it."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmax(total[: end + 1] == low[end]))
    return start, end, int(equal[start:end].sum())


def enough(h: np.ndarray, items: Items, item: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether as many words are equal as count, for each item laid over the text from ``start``."""
    if not len(item):
        return np.zeros(0, bool)
    lo, hi = np.maximum(0, -start), np.minimum(items.sizes[item], len(h) - start)
    n, out = hi - lo, np.zeros(len(item), bool)
    cuts = np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), 1 << 20))
    for a, b in zip(cuts, [*cuts[1:], len(item)], strict=True):
        if a == b:
            continue
        m = n[a:b]
        begin = np.cumsum(m) - m
        own = np.arange(m.sum())
        equal = items.flat[own + np.repeat(items.first[item[a:b]] + lo[a:b] - begin, m)] == h[own + np.repeat(start[a:b] + lo[a:b] - begin, m)]
        out[a:b] = np.add.reduceat(equal, begin, dtype=int) >= items.least[item[a:b]]
    return out


def overlaps(h: np.ndarray, items: Items) -> dict[int, tuple[int, int, int]]:
    """Per item found: equal words, first and last place (past it) in the text."""
    best: dict[int, tuple[int, int, int]] = {}
    laid = items.laid(h)
    for k, start in laid[:, enough(h, items, *laid)].T.tolist():
        w = items.words[k]
        lo, hi = max(0, -start), min(len(w), len(h) - start)
        a, b, n = stretch(w[lo:hi] == h[start + lo : start + hi])
        if n >= items.least[k] and n > best.get(k, (0,))[0]:
            best[k] = (n, start + lo + a, start + lo + b)
    return best


def _blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]] | object:
    sized = benchmark.where("text is not null").select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(1 << 30)).alias("h"))
    words = sized.agg(F.sum(F.size(F.split("text", "\\s+")))).first()[0] or 0
    n = max(1, math.ceil(words / BLOCK_WORDS))
    for k in range(n):
        yield [(r["item_id"], r["text"]) for r in sized.where(F.col("h") % n == k).distinct().orderBy("item_id", "text").collect()]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, n_matched, n_item (words), first_word, end_word, overlap."""
    spark = docs.sparkSession
    out = None
    for rows in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(rows)
        found = docs.select("doc_id", text).mapInArrow(per_slice(_finder(sent, text), text), "doc_id bigint, item_id bigint, n_matched int, n_item int, first_word bigint, end_word bigint")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("overlap", F.col("n_matched") / F.col("n_item"))


def _finder(sent, text: str):
    state: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.extend([Items(sent.value, LIGHT), WordHashes()])
        items, hashes = state
        out: dict[str, list] = {c: [] for c in ("doc_id", "item_id", "n_matched", "n_item", "first_word", "end_word")}
        texts = batch.column(text).to_pylist()
        lists = [tokens(t) for t in texts]
        flat = hashes([w for t in lists for w in t])
        ends = np.cumsum([0, *map(len, lists)])
        for doc, t, a, b in zip(batch.column("doc_id").to_pylist(), texts, ends, ends[1:], strict=False):
            found = [(items.ids[k], n, len(items.words[k]), first, end) for k, (n, first, end) in overlaps(flat[a:b], items).items()]
            found += [(i, n, n, first, end) for i, (n, first, end) in items.lines(t).items()]
            for row in found:
                for c, v in zip(out, (doc, *row), strict=True):
                    out[c].append(v)
        return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32() if c in ("n_matched", "n_item") else pa.int64()) for c, v in out.items()})

    return run


def apply(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap with no benchmark item, with their own columns."""
    kept = docs
    for rows in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(rows)
        kept = kept.mapInArrow(per_slice(_dropper(sent), "text"), kept.schema)
    return kept


def _dropper(sent):
    state: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.extend([Items(sent.value, LIGHT), WordHashes()])
        items, hashes = state
        texts = batch.column("text").to_pylist()
        lists = [tokens(t) for t in texts]
        flat = hashes([w for t in lists for w in t])
        ends = np.cumsum([0, *map(len, lists)])
        return batch.filter(pa.array([not (overlaps(flat[a:b], items) or items.lines(t)) for t, a, b in zip(texts, ends, ends[1:], strict=False)], pa.bool_()))

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
