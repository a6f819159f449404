"""One query per registered strategy, each over every monthly rebalance."""

from __future__ import annotations

from ..operators import allocation as P
from .model_queries import _rebalance
from .registry import query


def _weights(name: str):
    @query(f"pf_{name}")
    def made(spark, d):
        return P.weigh(_rebalance(spark, d), name, "month", "entity", "past", ["cap", "ret"])

    return made


for _name in P.STRATEGIES:
    _weights(_name)
