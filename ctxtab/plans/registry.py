"""Query registry: one DataFrame query per operator plus its SQL twin.

Every query reads the driver tables (through the task-table builders in
``ctxtab.sources.tables``) and runs over whole tables.  The SQL twins are
written independently in plain ANSI SQL (DuckDB dialect) and serve as the
correctness oracle; numeric outputs are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the query modules (each registers itself)."""
    from ctxtab.plans import (q_clean, q_encode, q_predict, q_retrieve, q_scale, q_sources,  # noqa: F401
                              q_split, q_suite)
