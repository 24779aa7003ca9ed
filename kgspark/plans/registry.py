"""Query registry: name -> (builder over the given tables, optional SQL check)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from kgspark.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    check_sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, check_sql: str | None = None):
    """Register a builder. ``check_sql`` is the same question in plain SQL."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, fn, check_sql)
        return fn
    return wrap
