"""Substring dedup by hashing the lines and sentences of all documents.

A unit is a line, or a part of one between sentence ends. A unit of ``UNIT_WORDS`` words or more is normalised (lower case,
single spaces) and digested to 128 bits. All digests are grouped; the earliest occurrence, by
doc_id and then place, is kept, every other is a repeat. Repeats that follow each other in a
document form a run (shorter units between them go along); a run of ``RUN_WORDS`` words or
more is removed, and its offsets in the original text are reported. Sentences that happen to
stand in two documents stay: ``RUN_WORDS`` is what is left at least of a passage of 50 words
whose first and last sentence were joined to their surroundings.

Defined results: null, empty or unit-less texts have no runs; a document without doc_id can't
be ranked and stays whole; rows with one doc_id are ranked as one document and repeated rows
as one row; a table without repeats gives no rows; other columns stay as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import per_slice, table

UNIT_WORDS, RUN_WORDS = 3, 20
_CUT = re.compile("\n\\s*|(?<=[.!?…。！？])\\s+")


def units(text: str | None) -> list[tuple[int, int, int, bytes]]:
    """Start, end, words and digest of each unit that is long enough."""
    out, start = [], 0
    if not text:
        return out
    for a, b in [*(m.span() for m in _CUT.finditer(text)), (len(text), len(text))]:
        words = text[start:a].lower().split()
        if len(words) >= UNIT_WORDS:
            out.append((start, a, len(words), xxhash.xxh3_128_digest(" ".join(words).encode())))
        start = b
    return out


def _rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    doc, row, unit, start, end, words, digests, first = [], [], [], [], [], [], [], []
    for d, r, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
        seen: set[bytes] = set()
        for k, (a, b, n, h) in enumerate(units(t)):
            doc.append(d), row.append(r), unit.append(k), start.append(a), end.append(b), words.append(n), digests.append(h), first.append(h not in seen)
            seen.add(h)
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    ints = [pa.array(x, pa.int32()) for x in (unit, start, end, words)]
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(row, pa.int64()), *ints, pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(first, pa.bool_())], ["doc_id", "row", "unit", "start", "end", "words", "h1", "h2", "first_here"])


def _units_of(docs: DataFrame) -> DataFrame:
    named = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    return named.mapInArrow(per_slice(_rows), "doc_id bigint, row bigint, unit int, start int, end int, words int, h1 bigint, h2 bigint, first_here boolean")


def spans(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """Removed runs: doc_id, row (hash of the text), start, end (code points), n_units, n_words, first_doc_ids."""
    every = _units_of(docs)
    found = every.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeats = every.join(found, ["h1", "h2"]).where("doc_id <> first_doc or not first_here").drop("h1", "h2", "first_here").distinct()
    order = Window.partitionBy("doc_id", "row").orderBy("unit")
    runs = repeats.withColumn("run", F.col("unit") - F.row_number().over(order))
    joined = runs.groupBy("doc_id", "row", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_units"), F.sum("words").alias("n_words"), F.sort_array(F.collect_set("first_doc")).alias("first_doc_ids")
    )
    return joined.where(F.col("n_words") >= run_words).drop("run")


def _cut(text: Column, held: Column) -> Column:
    """``text`` without the sorted ``held`` spans."""
    n = F.size(held)
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(held, i - 1)["end"])
    stop = lambda i: F.coalesce(F.get(held, i)["start"], F.length(text))
    return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(text, begin(i) + 1, stop(i) - begin(i))), "")


def apply(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """The documents without their repeated runs; one that loses its last word goes, n_chars follows the text."""
    own = docs.columns
    held = spans(docs, run_words).groupBy(F.col("doc_id").alias("__doc"), F.col("row").alias("__row")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__held"))
    rows = docs.select(F.struct(*own).alias("__own"), F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    both = rows.join(held, (F.col("__id") == F.col("__doc")) & (F.xxhash64("__text") == F.col("__row")), "left")
    text = F.when(F.col("__held").isNull(), F.col("__text")).otherwise(_cut(F.col("__text"), F.col("__held")))
    left = both.withColumn("__text", text).where("__held is null or __text rlike '\\\\S'")
    new = {"text": F.col("__text"), "n_chars": F.when(F.col("__held").isNull(), F.col("__own.n_chars")).otherwise(F.length("__text")).cast("long") if "n_chars" in own else None}
    return left.select(*[new.get(c, F.col("__own").getField(c)).alias(c) for c in own])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents")).drop("row")
