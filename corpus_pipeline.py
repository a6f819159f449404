"""The corpus pipeline: quality rules, near duplicates, substring dedup, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and gets what the stage before kept, written as
Parquet and read again; all but the last return the columns of documents.

Defined results, for every stage: an empty table gives an empty one; extra columns stay up to
the last stage, whatever their names; null and empty texts fail the base quality rules and go
there, and each later stage takes them as texts without words; repeated rows are judged one by
one by the quality rules and one of them stays from near_duplicates on; of documents with one
doc_id and different texts one stays; rows without doc_id are never near duplicates, lose no
passages and are otherwise treated like others; ties go to the smallest doc_id."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard_join, pieces, quality, substring_dedup
from tidemark.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.apply(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.apply(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.apply(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.apply(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document, with the digests of ids and decoded text."""
    encoded = pieces.encode(docs.select("doc_id", "text"))
    return pieces.decode(encoded.drop("text")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("tokens", tokens),
]
#: SentencePiece can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
    return docs
