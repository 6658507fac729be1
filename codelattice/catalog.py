"""All registered queries of the code-graph engine, by name."""

from __future__ import annotations

from .plans import oracles
from .plans.queries import QUERIES, entry

__all__ = ["entry", "oracle_sql", "queries"]


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {name: sql for name, sql in oracles.build().items() if name in QUERIES}
