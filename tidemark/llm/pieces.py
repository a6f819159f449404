"""SentencePiece encoding and decoding through a distinct-chunk table.

No piece of the model holds a whitespace marker after another character, and none but its
byte piece holds a line feed (both are checked when the model is loaded). Merges therefore
never cross the start of a run of markers or a line feed, and a text's ids are the ids of
its chunks in order. Each task segments a distinct chunk once and joins ids by position.

Defined results: null text counts as empty and gives no ids; any other text, however long,
is encoded whole; a null id list decodes to the empty text; repeated rows give repeated
results; an empty table gives an empty one; other columns stay, a column named as the
output is replaced.
"""

from __future__ import annotations

import functools
import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ChunkTable, joined, per_slice, release, table

_CHUNK = re.compile("\n|▁*[^▁\n]+|▁+")


@functools.cache
def model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def _chunks(path: str) -> ChunkTable | None:
    """The worker's table, or None if the model's pieces may cross markers (then texts are encoded plainly)."""
    sp = model(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
    head = sp.encode("\n")
    if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) or len(head) != 2 or sp.encode("\n ") != [*head, sp.piece_to_id("▁")]:
        return None
    return ChunkTable(lambda new: joined([x[2:] for x in sp.encode(["\n" + c for c in new], num_threads=1)]), limit=150_000)


def encode_texts(texts: list[str | None], path: str) -> tuple:
    """Flat ids and offsets."""
    chunks = _chunks(path)
    if chunks is None:
        import numpy as np

        ids = model(path).encode([t or "" for t in texts], num_threads=1)
        return np.array([i for x in ids for i in x], np.int32), np.cumsum([0, *map(len, ids)])
    return chunks.ids([_CHUNK.findall("▁" + t.replace(" ", "▁")) if t else [] for t in texts])


def encode(df: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    df = df.drop(ids)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, at = encode_texts(batch.column(text).to_pylist(), path)
        out = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
        return pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, ids])

    def task(batches):
        yield from per_slice(run, text)(batches)
        if chunks := _chunks(path):  # an idle worker holds no table
            chunks.clear()
            release()

    return df.mapInArrow(task, schema)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    df = df.drop(text)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = model(path).decode([x or [] for x in batch.column(ids).to_pylist()], num_threads=1)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    return df.mapInArrow(per_slice(run, ids), schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the encoded and decoded texts."""
    back = decode(encode(docs.select("doc_id", "text")).drop("text"))
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
