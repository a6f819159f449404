"""Language identification by compression.

Per language, training texts are joined to a raw-content zstandard dictionary; a text is
cut into pieces of ``PIECE`` bytes (all of it, the last one shorter), every piece is
compressed with each language's dictionary, and the language with the smallest total wins.
Where the best total is not at least ``MARGIN`` below the second the prediction is marked
as not ``sure`` (the general interface's rejection).

The dictionaries come from at most ``TRAIN_ROWS`` different whole texts with letters per
language, of any length, those with the smallest hash: a bounded sample that does not depend
on row order. The shortest of them come last in the dictionary, where matches cost least.

Defined results: null text, or text without any letter, gives ``und`` with score 0; ties go
to the alphabetically first language; rows with null lang or null text are never learned
from; without any training row every prediction is ``und``; repeated rows are each judged.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_slice, table

TRAIN_ROWS, PIECE, LEVEL, MARGIN = 64, 1 << 12, 6, 0.01
_OTHER = re.compile(r"[\W\d_]+")


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> dict[str, bytes]:
    """Dictionary bytes per language from columns ``text`` and ``lang``: at most ``rows`` different whole texts a language.

    Copies are put together and ranked by their hash alone, per salt and then over the salts,
    so that no task sees a language whole; the texts of the chosen hashes are read afterwards."""
    from pyspark.sql import Window

    fit = labelled.where("lang is not null").where(F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    keyed = fit.select("lang", "h").distinct().withColumn("salt", F.pmod("h", F.lit(64)))
    for keys in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
        keyed = keyed.withColumn("rank", rank).where(F.col("rank") <= rows).drop("rank")
    found: dict[str, list[tuple[int, str]]] = {}
    for r in fit.join(F.broadcast(keyed.select("lang", "h")), ["lang", "h"], "left_semi").select("lang", "h", "text").distinct().orderBy("lang", "h", "text").collect():
        if len(held := found.setdefault(r["lang"], [])) < rows:
            held.append(r["text"])
    return {lang: "\n".join(letters(t) for t in sorted(ts, key=len, reverse=True)).encode() for lang, ts in found.items()}


@functools.lru_cache(4)
def _compressors(model: tuple[tuple[str, bytes], ...]):
    out = []
    for _, content in model:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def letters(text: str) -> str:
    """The text's words in lower case, single spaces between: case and punctuation tell nothing of the language."""
    return _OTHER.sub(" ", text.lower())


def sizes(text: str, model: tuple[tuple[str, bytes], ...]) -> list[int]:
    """Compressed bytes of the whole text with each dictionary."""
    data = letters(text).encode()
    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
    return [sum(len(c.compress(p)) for p in pieces) for c in _compressors(model)]


def classify(text: str | None, model: tuple[tuple[str, bytes], ...]) -> tuple[str, float, bool]:
    if not text or not model or not any(map(str.isalpha, text)):
        return "und", 0.0, False
    got = sizes(text, model)
    best = min(got)
    k = got.index(best)
    rest = min((g for i, g in enumerate(got) if i != k), default=2 * best)
    margin = (rest - best) / rest
    return model[k][0], 0.5 + 0.5 * margin, margin >= MARGIN


def predict(df: DataFrame, model: dict[str, bytes], text: str = "text") -> DataFrame:
    """``df`` plus lang_pred, score and sure."""
    frozen = tuple(sorted(model.items()))
    df = df.drop("lang_pred", "score", "sure")
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("sure", T.BooleanType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = pd.DataFrame([classify(t, frozen) for t in batch.column(text).to_pylist()], columns=["l", "s", "b"])
        new = [pa.array(got["l"], pa.string()), pa.array(got["s"], pa.float64()), pa.array(got["b"], pa.bool_())]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score", "sure"])

    return df.mapInArrow(per_slice(run, text), schema)


def held_out(mod: int, rest: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod)) == rest


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"))
    model = train(docs.where("not held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "sure")
