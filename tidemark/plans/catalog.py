"""All registered queries of the analytics engine, with their DuckDB counterparts."""

from __future__ import annotations

from . import allocation_queries, model_queries, more_queries, panel_queries, signal_queries, tick_queries, validation_queries  # noqa: F401
from .registry import ORACLES, QUERIES, Query

FLAGSHIP: Query = panel_queries.composite


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
