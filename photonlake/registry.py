"""Where query modules register a Spark query and, if SQL can express it, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: str = ""):
    """Register a function of (spark, sf_dir); ``base`` holds the common table expressions that ``sql`` reads."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = base + sql
        return f

    return add
