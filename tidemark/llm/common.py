"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handled at once by a Python worker, in bytes; one longer text is handled alone and whole.
SLICE_BYTES = 1 << 21
#: Characters of distinct chunks that a worker's table holds before it is emptied.
CHUNK_CHARS = 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about SLICE_BYTES of ``column``; every row stays."""
    held_in = batch.column(column)
    if pa.types.is_list(held_in.type):
        sizes = pc.multiply(pc.fill_null(pc.list_value_length(held_in), 0), 4).to_pylist()
    else:
        sizes = pc.fill_null(pc.binary_length(held_in), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def release() -> None:
    """Give freed memory back to the machine, so that a worker between tasks holds little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def per_slice(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text"):
    """A mapInArrow function that applies ``fn`` slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
                out = None
            batch = part = None
        release()

    return run


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; only a single machine may go without one and gets a temporary folder of its own."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{tempfile.gettempdir()}/checkpoints"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder in spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class Codes(dict):
    """Distinct keys numbered in the order they are first seen."""

    def __missing__(self, key):
        code = self[key] = len(self)
        return code


class ChunkTable:
    """Ids of each distinct chunk, found once; texts are joined back from them by position.

    ``segment`` maps a list of new chunks to their id counts and joined ids. The table is
    emptied when it holds more than ``limit`` chunks or ``CHUNK_CHARS`` characters of them, so
    that a worker's memory stays bounded; that only costs a second segmentation, never a different result."""

    def __init__(self, segment: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 300_000):
        self.segment, self.limit = segment, limit
        self.clear()

    def clear(self) -> None:
        self.codes, self.done, self.chars = Codes(), 0, 0
        self.starts = self.lengths = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _known(self, chunks: list[str]) -> np.ndarray:
        if len(self.codes) > self.limit or self.chars > CHUNK_CHARS:
            self.clear()
        code = np.fromiter(map(self.codes.__getitem__, chunks), np.int64, len(chunks))
        if len(self.codes) > self.done:
            new = list(itertools.islice(self.codes, self.done, None))
            self.chars += sum(map(len, new))
            sizes, joined = self.segment(new)
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
            self.lengths = np.concatenate([self.lengths, sizes])
            self.pool = np.concatenate([self.pool, joined.astype(np.int32)])
            self.done = len(self.codes)
        return code

    def _join(self, code: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.lengths[code]
        ends = np.cumsum(size)
        out = self.pool[np.repeat(self.starts[code] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.concatenate([[0], ends])[cut]

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts (given as chunk lists) and the offset of each text in them."""
        return self._join(self._known([c for t in texts for c in t]), np.cumsum([0, *map(len, texts)]))

    def ids_of_lists(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The same for an Arrow list of chunks per text."""
        return self.ids_of(lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py())

    def ids_of(self, flat: pa.StringArray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for all chunks in a row and the texts' offsets in them; only distinct chunks become Python strings."""
        coded = flat.dictionary_encode()
        code = self._known(coded.dictionary.to_pylist())
        return self._join(code[coded.indices.to_numpy()], cut)


def joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return sizes, np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum()))


def durable_table(df: DataFrame) -> DataFrame:
    """Write to a new Parquet folder under spark.checkpoint.dir and read it back (columns can be picked on reading)."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
