"""Registered queries: operators composed over the test tables, with the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with DuckDB's SQL for the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def load() -> None:
    from provena.plans import claims, decisions, evidence, extraction, graph_memory, ranking, records, rules, similarity, sourcing, spine, trust  # noqa: F401
