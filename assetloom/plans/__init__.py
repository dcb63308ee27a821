"""Named queries with their SQL, and read-only ad-hoc SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..storage import configure
from . import files, relational, stream, web

_MODULES = (web, files, relational, stream)


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings that results depend on."""
    return configure(spark)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    return {name: (lambda spark, d, f=f: f(prepared(spark), d)) for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB's SQL by query."""
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
