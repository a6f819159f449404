"""Toxicity by a convolutional text classifier, trained and run in numpy.

A word is the mean of hashed embeddings of itself and of its 3- to 5-letter starts. Filters
of several widths run over all words of a text; each filter's maximum over the text goes
through a rectifier into a logistic output. Distinct words are embedded and multiplied with
the filters once, so that a text's responses are sums of looked-up rows.

The model is fitted on every labelled row given, whole texts of any length. The rows are dealt by
doc_id into shards of about ``SHARD`` labels, which are coded once. Counts are sums over all
shards. In each of ``ROUNDS`` rounds every shard goes on from the common model for its part of
the epochs, and the shards' models are averaged by their rows (a bucket's embedding over the
shards whose texts hold it); a single shard is fitted in one go. A quarter of the rows, by the
hash of doc_id, is held back from the fit to calibrate, per language, the threshold on the
output; the score is a logistic function of the distance to it, so 0.5 is the threshold. Six
bytes a row held back go to the driver for that. The language of a text is itself predicted from
the same hashed words (lang is learned from the training rows and is no input of a score).

Defined results: null or wordless text gets the score of a text with no response (below 0.5);
without labelled rows of both classes every score is 0; texts of any length are scored whole;
repeated rows are each scored; other columns stay, those named as an output are replaced.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Codes, durable, per_slice, release, slices, table

BUCKETS, DEPTH, WIDTHS, FILTERS = 1 << 15, 12, (1, 2, 3), 8
EPOCHS, BATCH, RATE = 12, 32, 0.01
#: Words whose responses are held at once; one longer text is handled alone and whole.
BLOCK = 1 << 12
#: Labels a shard holds about, rounds of averaging, and blocks in which sums over shards are made.
SHARD, ROUNDS, PARTS = 8192, 4, 16
#: Filter width (by its number) and place in the filter of each block of FILTERS products.
SPOTS = [(w, j) for j in range(max(WIDTHS)) for w in range(len(WIDTHS)) if j < WIDTHS[w]]
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def buckets(word: str) -> tuple[int, int, int, int]:
    """Hash buckets of a word and of its starts (marked, so that a start isn't a word)."""
    h = xxhash.xxh3_64_intdigest
    return (h(word) % BUCKETS, h(word[:3] + "-") % BUCKETS, h(word[:4] + "-") % BUCKETS, h(word[:5] + "-") % BUCKETS)


def coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the distinct words, the texts' words as codes into them, and the texts' offsets."""
    lists = [words(t) for t in texts]
    flat = list(itertools.chain.from_iterable(lists))
    codes = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    held = np.array([buckets(w) for w in codes], np.int64).reshape(-1, 4)
    return held, np.fromiter(map(codes.__getitem__, flat), np.int64, len(flat)), np.cumsum([0, *map(len, lists)])


class Model:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embed = rng.normal(0, 0.1, (BUCKETS, DEPTH)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, DEPTH, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.tongue = np.zeros((BUCKETS, max(1, len(languages))), np.float32)
        self.cut = np.zeros(max(1, len(languages)), np.float32)

    def vectors(self, held: np.ndarray) -> np.ndarray:
        return sum(self.embed.take(held[:, k], axis=0) for k in range(4)) / np.float32(4)

    def products(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The products of every distinct word, and last of no word, with each place of each filter, in the order of SPOTS."""
        vectors = np.concatenate([vectors, np.zeros((1, DEPTH), np.float32)])
        return [vectors @ self.filters[w][j] for w, j in SPOTS]

    @staticmethod
    def responses(products: list[np.ndarray], flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's responses (a row) at all places of the texts, which have so many words, and where each text starts.

        After every text stand places of no word; a text shorter than a filter is padded with them."""
        most = max(WIDTHS)
        start = np.cumsum(size + most) - size - most
        code = np.full(int(size.sum()) + most * len(size), len(products[0]) - 1)
        code[np.arange(len(flat)) + np.repeat(np.arange(len(size)) * most, size)] = flat
        rows = [x.take(code, axis=0) for x in products]
        for (w, j), x in zip(SPOTS, rows, strict=True):
            if j:
                rows[w][:-j] += x[j:]
        for w, width in enumerate(WIDTHS):
            for back in range(1, most + width):
                place = size + most - back
                rows[w][(start + place)[place >= np.maximum(1, size - width + 1)]] = -np.inf
        return np.concatenate([x.T for x in rows[: len(WIDTHS)]]), start

    def logits(self, held: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        products, size = self.products(self.vectors(held)), np.diff(ends)
        hidden = np.zeros((len(size), len(self.bias)), np.float32)
        block = (ends[:-1] + max(WIDTHS) * np.arange(len(size))) // BLOCK
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(size)] if len(size) else []
        for a, b in itertools.pairwise(cuts):
            response, start = self.responses(products, flat[ends[a] : ends[b]], size[a:b])
            hidden[a:b] = np.maximum.reduceat(response, start, axis=1).T
        return np.maximum(hidden + self.bias, 0) @ self.out + self.shift[0]

    def language(self, held: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        per_word = self.tongue[held[:, 0]]
        total = np.concatenate([np.zeros((1, per_word.shape[1])), np.cumsum(per_word[flat], 0, dtype=np.float64)])
        return np.argmax(total[ends[1:]] - total[ends[:-1]], axis=1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        held, flat, ends = coded(texts)
        if not len(flat):
            held = np.zeros((1, 4), np.int64)
        return 1 / (1 + np.exp(-np.clip(self.logits(held, flat, ends) - self.cut[self.language(held, flat, ends)], -30, 30)))


@dataclass
class Shard:
    """Coded texts: buckets of the distinct words, the texts' words as codes into them, offsets; label, held back, lang."""

    held: np.ndarray
    flat: np.ndarray
    ends: np.ndarray
    label: np.ndarray
    back: np.ndarray
    tongue: list[str | None]

    def pick(self, which: np.ndarray) -> Shard:
        size = np.diff(self.ends)
        flat = self.flat[np.repeat(which, size)]
        tongue = [t for t, k in zip(self.tongue, which, strict=True) if k]
        return Shard(self.held, flat, np.cumsum([0, *size[which]]), self.label[which], self.back[which], tongue)


_PACKED = "held binary, flat binary, sizes binary, label binary, back binary, tongue array<string>"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of a partition's rows (sorted by doc_id) as one shard. A doc_id counts once: toxic if any row is, with its first text."""
    codes, coded_texts, label, back, tongue = Codes(), [], [], [], []
    last = None

    def close() -> None:
        text, known, lang = last["key"]
        coded_texts.append(np.fromiter((codes[w] for w in words(text)), np.uint32))
        label.append(last["toxic"])
        back.append(last["back"])
        tongue.append(lang if known else None)

    for batch in batches:
        for part in slices(batch, "text"):
            for r in part.to_pylist():
                r["key"] = (r.pop("text"), r["lang"] is not None, r["lang"] or "")
                if last is not None and last["doc_id"] == r["doc_id"]:
                    last["key"], last["toxic"] = min(last["key"], r["key"]), max(last["toxic"], r["toxic"])
                    continue
                if last is not None:
                    close()
                last = r
    if last is not None:
        close()
        held = np.array([buckets(w) for w in codes], np.uint16).reshape(-1, 4)
        flat = np.concatenate(coded_texts).astype(np.uint16 if len(codes) <= 1 << 16 else np.uint32)
        sizes = np.array([len(c) for c in coded_texts], np.int32)
        row = [held.tobytes(), flat.tobytes(), sizes.tobytes(), np.array(label, np.int8).tobytes(), np.array(back, np.bool_).tobytes()]
        names = ["held", "flat", "sizes", "label", "back", "tongue"]
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in row), pa.array([tongue], pa.list_(pa.string()))], names)
    release()


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            held, flat, sizes, label, back = (batch.column(k)[i].as_buffer() for k in range(5))
            ends = np.cumsum([0, *np.frombuffer(sizes, np.int32)])
            wide = np.uint32 if len(flat) == 4 * ends[-1] else np.uint16
            held = np.frombuffer(held, np.uint16).reshape(-1, 4).astype(np.int64)
            yield Shard(held if len(held) else np.zeros((1, 4), np.int64), np.frombuffer(flat, wide).astype(np.int64), ends, np.frombuffer(label, np.int8), np.frombuffer(back, np.bool_), batch.column(5)[i].as_py())


def _summed(store: DataFrame, fn: Callable[[Shard], np.ndarray], kind: type) -> np.ndarray:
    """The sum over all shards of a vector that ``fn`` makes of each; ``kind`` is the type that leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for shard in _shards(batches):
            got = fn(shard).astype(np.float64)
            total = got if total is None else total + got
        if total is not None:
            blocks = [x.astype(kind).tobytes() for x in np.array_split(total, PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(blocks, pa.binary())], ["part", "total"])
        release()

    def add(key: tuple, blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(x.as_buffer(), kind).astype(np.float64) for b in blocks for x in b.column(1))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "total"])

    sums = store.mapInArrow(run, "part int, total binary").groupBy("part").applyInArrow(add, "part int, total binary").collect()
    return np.concatenate([np.frombuffer(r["total"], np.float64) for r in sorted(sums, key=lambda r: r["part"])])


def _flat(model: Model) -> np.ndarray:
    return np.concatenate([p.ravel() for p in (model.embed, *model.filters, model.bias, model.out, model.shift)])


def _views(model: Model, params: np.ndarray) -> list[np.ndarray]:
    """Make the model's parameters views of one vector."""
    out, at = [], 0
    for p in (model.embed, *model.filters, model.bias, model.out, model.shift):
        out.append(params[at : at + p.size].reshape(p.shape))
        at += p.size
    model.embed, model.filters, (model.bias, model.out, model.shift) = out[0], out[1:-3], out[-3:]
    return out


def _fit(model: Model, rows: Shard, epochs: int, seed: int) -> None:
    """Adam on the logistic loss; a filter's gradient goes to the words where its maximum was.

    Moments and values of a bucket's embedding move when it has a gradient."""
    rng = np.random.default_rng(seed)
    held, flat, ends, label = rows.held, rows.flat, rows.ends, rows.label
    small = [*model.filters, model.bias, model.out, model.shift]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (model.embed, *small)]
    number, step, filters = np.zeros(len(held), np.int64), 0, np.arange(len(model.bias))
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for b in range(0, len(order), BATCH):
            picked = order[b : b + BATCH]
            size = ends[picked + 1] - ends[picked]
            pieces = np.concatenate([flat[ends[i] : ends[i + 1]] for i in picked])
            number[pieces] = 1
            used = np.flatnonzero(number)
            number[used] = np.arange(len(used))
            again = number[pieces]
            number[used] = 0
            own = held[used] if len(used) else np.zeros((1, 4), np.int64)
            vectors = model.vectors(own)
            response, start = model.responses(model.products(vectors), again, size)
            place = np.stack([response[:, a:z].argmax(1) for a, z in zip(start, [*start[1:], response.shape[1]], strict=True)])
            top = response[filters, start[:, None] + place]
            hidden = np.maximum(top + model.bias, 0)
            slope = ((1 / (1 + np.exp(-np.clip(hidden @ model.out + model.shift[0], -30, 30))) - label[picked]) / len(picked)).astype(np.float32)
            back = slope[:, None] * model.out * (hidden > 0)
            first, at, moves, grads = np.cumsum(size) - size, [], [], []
            for w, width in enumerate(WIDTHS):
                some = slice(w * FILTERS, (w + 1) * FILTERS)
                grads.append(np.zeros_like(model.filters[w]))
                for j in range(width):
                    i, f = np.nonzero((back[:, some] != 0) & (place[:, some] + j < size[:, None]))
                    word, pull = again[first[i] + place[:, some][i, f] + j], back[:, some][i, f]
                    np.add.at(grads[w][j].T, f, pull[:, None] * vectors[word])
                    at.append(own[word])
                    moves.append(pull[:, None] * model.filters[w][j].T[f] / 4)
            step += 1
            moved, which = np.unique(np.concatenate(at), return_inverse=True)
            spread = np.repeat(np.concatenate(moves), 4, axis=0)
            pulled = np.stack([np.bincount(which.ravel(), spread[:, d], len(moved)) for d in range(DEPTH)], axis=1).astype(np.float32)
            grads = [pulled, *grads, back.sum(0), slope @ hidden, slope.sum(keepdims=True)]
            for p, g, (m, v), rows_of in zip((model.embed, *small), grads, moments, (moved, *[slice(None)] * len(small)), strict=True):
                m[rows_of] = x = 0.9 * m[rows_of] + 0.1 * g
                v[rows_of] = y = 0.999 * v[rows_of] + 0.001 * g * g
                p[rows_of] -= RATE * (x / (1 - 0.9**step)) / (np.sqrt(y / (1 - 0.999**step)) + 1e-8)


def _seen(rows: Shard) -> np.ndarray:
    """Texts of each class that hold each bucket."""
    seen = np.zeros((2, BUCKETS))
    for i, (a, b) in enumerate(zip(rows.ends, rows.ends[1:], strict=False)):
        seen[int(rows.label[i])][np.unique(rows.held[np.unique(rows.flat[a:b])])] += 1
    return seen


def _start(model: Model, seen: np.ndarray, shares: list[int]) -> None:
    """The first coordinate starts as each bucket's smoothed log odds, and one filter reads it."""
    rate = (seen + 0.5) / (np.array(shares)[:, None] + 1)
    model.embed[:, 0] = np.clip(np.log(rate[1] / rate[0]), -3, 3)
    model.filters[0][0, :, 0], model.filters[0][0, 0, 0], model.bias[0], model.out[0], model.shift[0] = 0, 1, -1, 2, -1


def _round(store: DataFrame, model: Model, epochs: int, seed: int, hold: bool) -> None:
    """Every shard goes on from ``model`` for some epochs; then their models are averaged into it."""
    start = _flat(model)

    def local(shard: Shard) -> np.ndarray:
        rows = shard.pick(~shard.back) if hold else shard
        own, params = Model([]), start.copy()
        _views(own, params)
        if len(rows.label):
            _fit(own, rows, epochs, seed)
        weight = np.full(start.size, float(len(rows.label)))
        touched = np.zeros(BUCKETS)
        touched[rows.held[np.unique(rows.flat)].ravel()] = len(rows.label)
        weight[: BUCKETS * DEPTH] = np.repeat(touched, DEPTH)
        return np.concatenate([_flat(own) * weight, touched, [len(rows.label)]])

    got = _summed(store, local, np.float32)
    weight = np.concatenate([np.repeat(got[start.size : -1], DEPTH), np.full(start.size - BUCKETS * DEPTH, got[-1])])
    _views(model, np.where(weight > 0, got[: start.size] / np.maximum(weight, 1), start).astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, shard: int = SHARD) -> Model | None:
    """A model from all of docs (doc_id, text, lang) and labels (doc_id, toxic); rows without text or label are ignored.

    A doc_id counts once. ``shard`` is about how many labels are fitted on in one go."""
    known = labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    parts = max(1, -(-known.count() // shard))
    texts = docs.where("length(text) > 0").select("doc_id", "text", "lang", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3).alias("back"))
    marked = known.repartition(parts, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    dealt = texts.repartition(parts, "doc_id").join(marked, "doc_id")  # both sides dealt alike, so that the shards are the partitions
    store = durable(dealt.sortWithinPartitions("doc_id").select("doc_id", "text", "lang", "back", "toxic").mapInArrow(_packed, _PACKED)).coalesce(parts)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _shards(batches):
            rows = [{"lang": g, "toxic": y, "back": h, "n": n} for (g, y, h), n in Counter(zip(x.tongue, x.label.tolist(), x.back.tolist(), strict=True)).items()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("lang", pa.string()), ("toxic", pa.int32()), ("back", pa.bool_()), ("n", pa.int64())]))

    tallies = store.mapInArrow(tally, "lang string, toxic int, back boolean, n long").groupBy("lang", "toxic", "back").agg(F.sum("n").alias("n")).collect()
    shares = [sum(r["n"] for r in tallies if r["toxic"] == c) for c in (0, 1)]
    if not all(shares):
        return None
    fitted = [sum(r["n"] for r in tallies if r["toxic"] == c and not r["back"]) for c in (0, 1)]
    hold = all(fitted)
    languages = sorted({r["lang"] for r in tallies if r["lang"] is not None})

    def counts(x: Shard) -> np.ndarray:
        spoken = np.zeros((len(languages), BUCKETS))
        size, tongue = np.diff(x.ends), np.array([languages.index(t) if t is not None else -1 for t in x.tongue])
        each = np.repeat(tongue, size)
        for k in range(len(languages)):
            spoken[k] = np.bincount(x.held[x.flat[each == k], 0], minlength=BUCKETS)
        return np.concatenate([_seen(x.pick(~x.back) if hold else x), spoken]).ravel()

    model, got = Model(languages), _summed(store, counts, np.float64).reshape(-1, BUCKETS)
    _start(model, got[:2], fitted if hold else shares)
    if languages:
        count = got[2:].T + 0.1
        share = np.log(count / count.sum(0))
        model.tongue = (share - share.mean(1, keepdims=True)).astype(np.float32)
    rounds = 1 if parts == 1 else ROUNDS
    for k in range(rounds):
        _round(store, model, EPOCHS // rounds, 11 + k, hold)
    _calibrate(model, store, shares, hold)
    return model


def _calibrate(model: Model, store: DataFrame, shares: list[int], hold: bool) -> None:
    """Per language, the cut with the best F1 on all rows held back, weighted to the classes' true shares."""

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _shards(batches):
            x = x.pick(x.back) if hold else x
            logit, tongue = model.logits(x.held, x.flat, x.ends), model.language(x.held, x.flat, x.ends)
            got = [logit.astype(np.float32).tobytes(), tongue.astype(np.uint8 if len(model.cut) <= 256 else np.int32).tobytes(), x.label.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.binary()) for g in got], ["logit", "tongue", "label"])

    sent = store.mapInArrow(outputs, "logit binary, tongue binary, label binary").collect()
    logit, tongue, label = (np.frombuffer(b"".join(r[k] for r in sent), t) for k, t in enumerate((np.float32, np.uint8 if len(model.cut) <= 256 else np.int32, np.int8)))
    weight = np.array([shares[0] / max(1, (label == 0).sum()), shares[1] / max(1, (label == 1).sum())])

    def best(pick: np.ndarray) -> float | None:
        x, y = logit[pick], label[pick]
        if not 0 < y.sum(dtype=np.int64) < len(y):
            return None
        order = np.argsort(-x, kind="stable")
        hit, false = np.cumsum(weight[1] * (y[order] == 1)), np.cumsum(weight[0] * (y[order] == 0))
        f1 = 2 * hit / (hit + false + hit[-1])
        f1[:-1][x[order[:-1]] == x[order[1:]]] = -1  # no cut parts equal outputs
        k = int(np.argmax(f1))
        return float(x[order[k]] + (x[order[k + 1]] if k + 1 < len(order) else x[order[k]] - 1)) / 2

    whole = best(np.ones(len(label), bool))
    for i in range(len(model.cut)):
        pick = tongue == i
        own = best(pick) if pick.sum() >= 30 else None
        model.cut[i] = own if own is not None else whole if whole is not None else 0.0


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` plus score and predicted."""
    df = df.drop("score", "predicted")
    if model is None:
        return df.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = model.scores(batch.column(text).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64()), pa.array(got >= 0.5).cast(pa.int32())], [*batch.schema.names, "score", "predicted"])

    return df.mapInArrow(per_slice(run, text), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs.where("not held_out").select("doc_id", "text", "lang"), labels)
    return predict(docs.select("doc_id", "held_out", "text"), model).drop("text")
