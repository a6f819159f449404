"""The training-data queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import compress_lang, decontaminate, html_text, jaccard_join, licenses, pieces, quality, rans, substring_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring_dedup.query,
        "op2_token_files": rans.query,
        "op3_toxicity": toxicity.query,
        "op4_main_text": html_text.query,
        "op5_sentencepiece": pieces.query,
        "op6_decontamination": decontaminate.query,
        "op7_quality_rules": quality.query,
        "op8_jaccard_join": jaccard_join.query,
        "op9_licenses": licenses.query,
        "op10_language": compress_lang.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_quality_rules": quality.oracle(),
        "op8_jaccard_join": jaccard_join.oracle(),
        "op9_licenses": licenses.oracle(),
    }
