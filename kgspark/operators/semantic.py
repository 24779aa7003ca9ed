"""Reusable metrics, filters and joins over logical tables.

``SemanticModel.query`` aggregates each fact table on its own and joins the results on
the dimensions, so facts never multiply each other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from kgspark.session import dealt


@dataclass(frozen=True)
class Join:
    """Declared many-to-one (or one-to-one) join from a table to a table keyed by ``right_key``."""

    name: str
    left: str
    right: str
    left_key: str
    right_key: str


@dataclass(frozen=True)
class Metric:
    name: str
    table: str
    expr: Column
    distinct: str | None = None  # the column whose distinct values ``expr`` counts


@dataclass(frozen=True)
class Filter:
    name: str
    table: str
    expr: Column


@dataclass
class SemanticModel:
    """Logical tables by name, with primary keys, and the operators declared on them.

    ``rows``: no fewer than a fact table has, where known; its distinct values are then counted on as many
    tasks as these ask for.
    """

    tables: dict[str, DataFrame]
    keys: dict[str, list[str]] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    joins: list[Join] = field(default_factory=list)
    metrics: dict[str, Metric] = field(default_factory=dict)
    filters: dict[str, Filter] = field(default_factory=dict)

    def add_metric(self, name: str, table: str, expr: Column) -> None:
        self.metrics[name] = Metric(name, table, expr)

    def add_distinct(self, name: str, table: str, column: str) -> None:
        self.metrics[name] = Metric(name, table, F.count_distinct(column), column)

    def add_filter(self, name: str, table: str, expr: Column) -> None:
        self.filters[name] = Filter(name, table, expr)

    def filtered(self, name: str) -> DataFrame:
        f = self.filters[name]
        return self.tables[f.table].where(f.expr)

    def _route(self, base: str, target: str) -> list[Join]:
        """Shortest chain of declared joins from base to target."""
        routes = {base: []}
        frontier = [base]
        while frontier and target not in routes:
            nxt = []
            for table in frontier:
                for j in self.joins:
                    if j.left == table and j.right not in routes:
                        routes[j.right] = routes[table] + [j]
                        nxt.append(j.right)
            frontier = nxt
        if target not in routes:
            raise ValueError(f"no declared join leads from {base} to {target}")
        return routes[target]

    def _widen(self, base: str, targets: Sequence[str]) -> DataFrame:
        """Base with the columns of the target tables, named table__column, by left joins."""
        df, done = self._named(base), {base}
        for target in targets:
            for j in self._route(base, target):
                if j.right in done:
                    continue
                on = F.col(f"{j.left}__{j.left_key}") == F.col(f"{j.right}__{j.right_key}")
                df = df.join(self._named(j.right), on, "left")
                done.add(j.right)
        return df

    def _named(self, table: str) -> DataFrame:
        df = self.tables[table]
        return df.select([F.col(c).alias(f"{table}__{c}") for c in df.columns])

    def _restore(self, df: DataFrame, table: str) -> DataFrame:
        return df.withColumns({c: F.col(f"{table}__{c}") for c in self.tables[table].columns})

    def _distinct_counts(self, df: DataFrame, keys: list[Column], metrics: Sequence[Metric], rows: int) -> DataFrame:
        """Distinct values of several columns by the keys: a row per column and value, made distinct where
        it is dealt, then counted."""
        none = {m.name: F.lit(None).cast(df.schema[m.distinct].dataType) for m in metrics}
        values = F.array(*[F.struct(*[(F.col(m.distinct) if m is own else none[m.name]).alias(m.name) for m in metrics])
                           for own in metrics])
        single = df.select(*keys, F.explode(values).alias("_value")).select("*", "_value.*").drop("_value")
        single = dealt(single, rows * len(metrics), *single.columns).distinct()
        names = single.columns[:len(keys)]
        return (single.groupBy(*names) if names else single.groupBy()).agg(
            *[F.count(m.name).alias(m.name) for m in metrics])

    def query(self, metrics: Sequence[str], dimensions: Sequence[str] = (),
              filters: Sequence[str] = ()) -> DataFrame:
        """Metrics by dimensions ("table.column") under named filters, as one lazy frame."""
        for name in metrics:
            if name not in self.metrics:
                raise ValueError(f"unknown metric {name}")
        for name in filters:
            if name not in self.filters:
                raise ValueError(f"unknown filter {name}")
        dims = [d.split(".") for d in dimensions]
        out_names = [c for _, c in dims]
        result, listed = None, []
        for fact in dict.fromkeys(self.metrics[m].table for m in metrics):
            wanted = [self.metrics[m] for m in metrics if self.metrics[m].table == fact]
            used = [self.filters[f] for f in filters]
            df = self._widen(fact, [t for t, _ in dims] + [f.table for f in used])
            for f in used:
                df = self._restore(df, f.table).where(f.expr)
            df = self._restore(df, fact)
            keys = [F.col(f"{t}__{c}").alias(f"dim__{c}") for t, c in dims]
            listed += [m.name for m in wanted]
            apart = [m for m in wanted if m.distinct and fact in self.rows]
            together = [m for m in wanted if m not in apart]
            aggs = []
            if together:
                aggs.append((df.groupBy(*keys) if keys else df.groupBy()).agg(*[m.expr.alias(m.name) for m in together]))
            if apart:
                aggs.append(self._distinct_counts(df, keys, apart, self.rows[fact]))
            for agg in aggs:
                agg = agg.withColumnsRenamed({f"dim__{c}": c for c in out_names})
                if result is None:
                    result = agg
                elif out_names:
                    right = agg.withColumnsRenamed({c: f"r__{c}" for c in out_names})
                    on = [F.col(c).eqNullSafe(F.col(f"r__{c}")) for c in out_names]
                    result = result.join(right, on, "full").withColumns(
                        {c: F.coalesce(c, f"r__{c}") for c in out_names}).drop(
                        *[f"r__{c}" for c in out_names])
                else:
                    # one row: all its metrics come from one subquery
                    row = agg.select(F.struct(*agg.columns)).scalar()
                    result = result.withColumn("_row", row).select("*", "_row.*").drop("_row")
        return result.select(*out_names, *listed)

    def duplicate_keys(self, table: str) -> DataFrame:
        """Rows that break the declared primary key; empty when many-to-one joins are safe."""
        return self.tables[table].groupBy(*self.keys[table]).count().where("count > 1")
