"""The corpus queries by name: (builder of (spark, folder), SQL check or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Build, str | None]] = {}


def query(name: str, check_sql: str | None = None):
    """Register a query with the same question in SQL, where SQL can express it."""
    def wrap(build: Build) -> Build:
        QUERIES[name] = (build, check_sql)
        return build
    return wrap
