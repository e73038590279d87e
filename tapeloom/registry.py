"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with SQL for the same rows."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


for _part in ("indicators", "structures", "candles", "dossier", "board", "market", "signals", "evaluation", "fundamentals", "storage", "vendor", "receipts", "reads", "pages", "reports", "company", "sinks", "desk"):
    import_module(f"tapeloom.plans.{_part}")
