"""Token ids in files coded with a static range asymmetric numeral system.

A file holds consecutive documents' ids under one frequency table that all its blocks
share. A block is ``LANES`` interleaved coder states over ``BLOCK`` ids (the last block may
be shorter); blocks are independent, their index (place, length, start states, crc32) is
the set of checkpoints from which they are decoded in parallel, and a numpy decoder steps
through all blocks at once. Every block's crc32, its coders' final states and the crc32 of
the whole file are checked on reading.

Layout, little-endian: magic ``TMR1``; u32 n_docs, n_tokens (u64), n_symbols, n_blocks,
n_words (u64); doc ids i64, doc id present u8, doc lengths u32; symbols u32, frequencies
u32 (sum ``1 << BITS``); per block n_words u32, crc32 u32, states u64 x LANES; words u32;
crc32 u32 of all before.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ChunkTable, durable_table, slices, table

MAGIC, BITS, LANES, BLOCK = b"TMR1", 20, 8, 1 << 12
LOW = np.uint64(1 << 31)
#: Ids in a file at most (a longer document has a file alone), and text bytes a partition is meant to hold.
FILE_IDS, PARTITION_BYTES = 1 << 21, 16 << 20
#: Added token of the tokenizer, put between chunks that are encoded together.
SEPARATOR = 49406
#: Chunks of these characters lower-case and compose to themselves, letter by letter; the second pattern cuts them as the tokenizer's does.
_PLAIN = re.compile(r"(?!.*<\|)[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_TEXT = r"^[ -~\n\t\rÀ-ÖØ-öø-ÿ]*$"
_SPACE, _DIGIT = 0, 1
_KIND = np.array([_SPACE if c in b" \n\t\r" else _DIGIT if chr(c) in "0123456789" else 2 if chr(c).isalpha() and c < 128 or c >= 128 else 3 for c in range(256)], np.uint8)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class CorruptFile(ValueError):
    """A checksum, state or length of a file does not fit."""


def _frequencies(counts: np.ndarray) -> np.ndarray:
    """Scale counts to a sum of 1 << BITS, each at least 1."""
    total = 1 << BITS
    freq = np.maximum(1, (counts * (total / counts.sum())).astype(np.int64))
    excess = int(freq.sum()) - total
    order = np.argsort(-freq, kind="stable")
    while excess:
        for i in order:
            step = min(excess, int(freq[i]) - 1) if excess > 0 else excess
            step = min(step, max(1, int(freq[i]) // 8)) if excess > 0 else step
            freq[i] -= step
            excess -= step
            if not excess:
                break
    return freq.astype(np.uint64)


def _encode_blocks(sym: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """``sym``: blocks x steps x LANES table indexes. Start states for the decoder and each block's words."""
    n, steps, _ = sym.shape
    x = np.full((n, LANES), LOW, np.uint64)
    block = np.repeat(np.arange(n), LANES).reshape(n, LANES)
    k, shift, words, owners = np.uint64(BITS), np.uint64(32), [], []
    for t in range(steps - 1, -1, -1):
        s = sym[:, t]
        f = freq[s]
        full = x >= (f << np.uint64(63 - BITS))
        if full.any():
            words.append(x[:, ::-1][full[:, ::-1]].astype(np.uint32))
            owners.append(block[full])
            x[full] >>= shift
        q = x // f
        x = (q << k) + (x - q * f) + cum[s]
    flat = np.concatenate(words)[::-1] if words else np.zeros(0, np.uint32)
    owner = np.concatenate(owners)[::-1] if owners else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    return x, np.split(flat[order], np.cumsum(np.bincount(owner, minlength=n))[:-1])


def _decode_blocks(states: np.ndarray, words: np.ndarray, starts: np.ndarray, steps: int, freq: np.ndarray, cum: np.ndarray, slots: np.ndarray) -> np.ndarray:
    x, at = states.copy(), starts.copy()
    out = np.empty((len(states), steps, LANES), np.uint32)
    k, mask, shift = np.uint64(BITS), np.uint64((1 << BITS) - 1), np.uint64(32)
    padded = np.concatenate([words, np.zeros(LANES, np.uint32)])
    for t in range(steps):
        slot = x & mask
        s = slots[slot]
        out[:, t] = s
        x = freq[s] * (x >> k) + slot - cum[s]
        need = x < LOW
        upto = np.cumsum(need, axis=1)
        got = padded[np.minimum(at[:, None] + upto - 1, len(padded) - 1)]
        x = np.where(need, (x << shift) | got, x)
        at += upto[:, -1]
    if (x != LOW).any():
        raise CorruptFile("final states")
    return out


def write_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    ids = np.asarray(ids, np.uint32)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    index = (np.cumsum(counts > 0) - 1)[ids]
    counts = counts[symbols]
    parts, n_words, n_blocks = [], 0, 0
    table_bytes = b""
    if len(ids):
        freq = _frequencies(counts)
        cum = np.cumsum(freq) - freq
        common = int(np.argmax(freq))
        words: list[np.ndarray] = []
        n_full = len(ids) // BLOCK
        shapes = [(0, n_full, BLOCK // LANES)] * bool(n_full) + [(n_full * BLOCK, 1, -(-(len(ids) % BLOCK) // LANES))] * bool(len(ids) % BLOCK)
        for start, n, steps in shapes:
            part = np.full(n * steps * LANES, common, np.int64)
            piece = index[start : start + len(part)]
            part[: len(piece)] = piece
            states, own = _encode_blocks(part.reshape(n, steps, LANES), freq, cum)
            for b in range(n):
                data = ids[start + b * steps * LANES : start + (b + 1) * steps * LANES].tobytes()
                parts.append(struct.pack("<II", len(own[b]), zlib.crc32(data)) + states[b].astype("<u8").tobytes())
            words += own
            n_blocks += n
        flat = np.concatenate(words)
        n_words = len(flat)
        parts.append(flat.astype("<u4").tobytes())
        table_bytes = symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes()
    head = MAGIC + struct.pack("<IQIIQ", len(doc_ids), len(ids), len(symbols), n_blocks, n_words)
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is not None for d in doc_ids], "u1").tobytes() + np.asarray(lengths, "<u4").tobytes()
    body = b"".join([head, docs, table_bytes, *parts])
    return body + struct.pack("<I", zlib.crc32(body))


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths and all ids; raises CorruptFile where a check fails."""
    if data[:4] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise CorruptFile("file checksum")
    n_docs, n_ids, n_sym, n_blocks, n_words = struct.unpack_from("<IQIIQ", data, 4)
    at = 4 + struct.calcsize("<IQIIQ")

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    doc, there, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
    doc_ids = [int(d) if p else None for d, p in zip(doc, there, strict=True)]
    if not n_ids:
        return doc_ids, lengths, np.zeros(0, np.uint32)
    symbols, freq = take("<u4", n_sym), take("<u4", n_sym).astype(np.uint64)
    index = take(np.dtype([("n", "<u4"), ("crc", "<u4"), ("x", "<u8", LANES)]), n_blocks)
    words = take("<u4", n_words)
    cum = np.cumsum(freq) - freq
    slots = np.repeat(np.arange(n_sym, dtype=np.uint32), freq.astype(np.int64))
    starts = np.cumsum(index["n"].astype(np.int64)) - index["n"]
    n_full = n_ids // BLOCK
    ids = []
    for lo, hi, steps in ((0, n_full, BLOCK // LANES), (n_full, n_blocks, -(-(n_ids % BLOCK) // LANES))):
        if hi > lo:
            ids.append(symbols[_decode_blocks(index["x"][lo:hi], words, starts[lo:hi], steps, freq, cum, slots).reshape(-1)])
    out = np.concatenate(ids)[:n_ids]
    for b in range(n_blocks):
        if zlib.crc32(out[b * BLOCK : (b + 1) * BLOCK].tobytes()) != index["crc"][b]:
            raise CorruptFile(f"block {b}")
    return doc_ids, lengths, out


@functools.cache
def _chunks(path: str) -> tuple[ChunkTable, ChunkTable]:
    """Tables of chunks and of words: the pre-tokenizer never crosses white space, so a text's ids are those of its
    space- or line-separated chunks, and a plain chunk's ids are those of the words it is cut into."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)

    mark = tok.id_to_token(SEPARATOR)
    ends_word = np.zeros(tok.get_vocab_size(), bool)
    ends_word[[i for t, i in tok.get_vocab().items() if t.endswith("</w>")]] = True

    def ids_of(texts: list[str]) -> np.ndarray:
        return np.concatenate([np.array(tok.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.int64) for t in texts])

    def by_separator(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Any chunks, many at a time with the separator token after each; a chunk that holds its text goes alone."""
        odd = [i for i, c in enumerate(new) if mark in c]
        plain = ["" if mark in c else c for c in new] if odd else new
        ids = ids_of([mark.join(plain[i : i + 1000]) + mark for i in range(0, len(plain), 1000)])
        at = np.flatnonzero(ids == SEPARATOR)
        sizes, ids = np.diff(at, prepend=-1) - 1, np.delete(ids, at)
        for i in reversed(odd):
            own = tok.encode(new[i], add_special_tokens=False).ids
            ids = np.insert(ids, sizes[:i].sum(), own)
            sizes[i] = len(own)
        return sizes, ids

    def by_word_ends(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words as the pre-tokenizer cuts them, each of which ends with a word-end token; checked by their number."""
        if "" in new:
            sizes, ids = by_word_ends([c for c in new if c]) if len(new) > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            return np.insert(sizes, new.index(""), 0), ids
        ids = ids_of([" ".join(new[i : i + 1000]) for i in range(0, len(new), 1000)])
        at = np.flatnonzero(ends_word[ids])
        return (np.diff(at, prepend=-1), ids) if len(at) == len(new) else by_separator(new)

    words = ChunkTable(by_word_ends)

    def segment(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut = [_PLAIN_WORDS.findall(c.lower()) if _PLAIN.fullmatch(c) else None for c in new]
        flat, at = words.ids([c or [] for c in cut])
        sizes = np.diff(at)
        other = [i for i, c in enumerate(cut) if c is None]
        if other:
            own_sizes, own = by_separator([new[i] for i in other])
            starts = at[:-1].copy()
            starts[other] = len(flat) + np.cumsum(own_sizes) - own_sizes
            sizes[other] = own_sizes
            upto = np.cumsum(sizes)
            flat = np.concatenate([flat, own])[np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1])]
        return sizes, flat

    return ChunkTable(segment), words


def tokenize(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and offsets of whole texts, exactly as the tokenizer gives them."""
    chunks, words = _chunks(path)
    texts = pc.fill_null(texts, "")
    if pc.all(pc.match_substring_regex(texts, _PLAIN_TEXT), min_count=0).as_py() and not pc.any(pc.match_substring(texts, "<|"), min_count=0).as_py():
        return words.ids_of(*_cut_plain(texts))
    return chunks.ids_of_lists(pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "))


def _cut_plain(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """The words of plain texts in lower case, cut as the tokenizer's pattern does, and the texts' offsets in them.

    Works on the texts' bytes at once: a word starts where the class of a byte changes, at every
    digit, and around an apostrophe that stands alone before one of the pattern's endings."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    second = np.flatnonzero(data == 0xC3) + 1
    data[second[data[second] != 0x9F]] |= 0x20
    kind = _KIND[data]
    start = np.ones(len(data), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    edge = np.zeros(len(data) + 4, bool)
    edge[at] = True
    start |= edge[: len(data)]
    wide = np.concatenate([data, np.zeros(4, np.uint8)])
    more = np.concatenate([start, np.ones(4, bool)])
    mark = np.flatnonzero(start & (data == 39) & more[1 : len(data) + 1])
    mark = mark[~edge[mark + 1]]
    one = mark[np.isin(wide[mark + 1], np.frombuffer(b"stmd", np.uint8))]
    pair = wide[mark + 1].astype(np.int32) * 256 + wide[mark + 2]
    two = mark[np.isin(pair, [a * 256 + b for a, b in (b"re", b"ve", b"ll")]) & ~edge[mark + 2]]
    more[one + 1] = more[two + 1] = False
    more[one + 2] = more[two + 3] = True
    first = np.flatnonzero(more[: len(data)])
    spans = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(first, len(data)).astype(np.int32)), pa.py_buffer(data))
    held = kind[first] != _SPACE
    return spans.filter(pa.array(held)), np.concatenate([[0], np.cumsum(held)])[np.searchsorted(first, at)]


def _files(path: str, end_id: int):
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        docs: list = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        n = 0

        def flush():
            nonlocal seq, docs, held, lengths, n
            sizes, ids = np.concatenate(lengths), np.concatenate(held)
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_docs": len(docs), "n_tokens": len(ids), "payload": write_file(docs, sizes, ids)}], schema)
            seq, docs, held, lengths, n = seq + 1, [], [], [], 0
            return row

        for batch in batches:
            for s in slices(batch, "text"):
                flat, at = tokenize(s.column("text"), path)
                sizes = np.diff(at)
                held.append(np.insert(flat, at[1:], end_id).astype(np.uint32))
                lengths.append(sizes + 1)
                docs += s.column("doc_id").to_pylist()
                n += len(held[-1])
                if n >= FILE_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Files of all documents in ascending doc_id order (nulls first, rows of one doc_id by a hash of their text), one row each: part, seq, n_docs, n_tokens, payload.

    Ordered by (part, seq) the files hold the documents in order. The texts are dealt out by
    ranges of doc_id, coded as they stream through a task, and the files are kept as binary
    rows by Spark's own committer in the shared folder, so that lost executors only cost time."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(min(200_000, max(8, total // PARTITION_BYTES)))
    order = ["doc_id", "tie", "text"]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions(*order).drop("tie")
    return durable_table(ordered.mapInArrow(_files(path, end_id), "part int, seq int, n_docs bigint, n_tokens bigint, payload binary"))


def read(files: DataFrame) -> DataFrame:
    """part, seq, place (of the document in its file), doc_id, local (ids of the file before it) and its ids."""

    def run(batches):
        for batch in batches:
            for part, seq, data in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "payload")), strict=True):
                docs, lengths, ids = read_file(data)
                at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                for lo in range(0, len(docs), 256):
                    hi = min(lo + 256, len(docs))
                    lists = pa.ListArray.from_arrays(pa.array(at[lo : hi + 1] - at[lo], pa.int32()), pa.array(ids[at[lo] : at[hi]].astype(np.int32), pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * (hi - lo), pa.int32()), pa.array([seq] * (hi - lo), pa.int32()), pa.array(range(lo, hi), pa.int32()), pa.array(docs[lo:hi], pa.int64()), pa.array(at[lo:hi], pa.int64()), lists],
                        ["part", "seq", "place", "doc_id", "local", "ids"],
                    )

    return files.select("part", "seq", "payload").mapInArrow(run, "part int, seq int, place int, doc_id bigint, local bigint, ids array<int>")


def digest(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)]
            keep = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], [*keep, "n_tokens", "ids_crc32"])

    each = read(files).mapInArrow(run, "part int, seq int, place int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return each.join(_file_starts(files), ["part", "seq"]).select("doc_id", (F.col("local") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _file_starts(files: DataFrame) -> DataFrame:
    """Ids before each file: sums within a part, then over the parts (one row a part, 200,000 at most)."""
    sizes = files.select("part", "seq", "n_tokens")
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = parts.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("earlier"))
    return sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(earlier, "part").select("part", "seq", (F.col("inside") + F.col("earlier")).alias("before"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(write(table(spark, sf_dir, "documents")))
