"""Typed views over the universal node and edge frames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from kgspark.functions.props import prop


def entity_view(nodes: DataFrame, node_type: str, props: Mapping[str, str]) -> DataFrame:
    """One node type with its properties as typed columns."""
    return nodes.where(F.col("node_type") == node_type).select(
        "node_id", "name", *[prop(p, dtype).alias(p) for p, dtype in props.items()])


def relation_view(edges: DataFrame, edge_type: str, src: str, dst: str,
                  props: Mapping[str, str]) -> DataFrame:
    """One edge type with endpoints named by role and typed properties."""
    return edges.where(F.col("edge_type") == edge_type).select(
        F.col("src_id").alias(src), F.col("dst_id").alias(dst), "effective_start", "effective_end",
        *[prop(p, dtype).alias(p) for p, dtype in props.items()])


def declared_view(nodes: DataFrame, node_type: str, properties: Iterable) -> DataFrame:
    """Entity view generated from declared property rows (name, data_type)."""
    return entity_view(nodes, node_type, {p.prop_name: p.data_type for p in properties})


def rebuild_props(df: DataFrame, **cols: Column) -> DataFrame:
    """Property bag rebuilt from typed columns, as comparable text; NULL keys are left out."""
    return df.withColumn("props_json", F.to_json(F.struct(*[c.alias(k) for k, c in cols.items()])))


def with_derived(df: DataFrame, derived: Iterable) -> DataFrame:
    """Add declared derived properties (prop_name, sql_expr) as columns."""
    return df.withColumns({d.prop_name: F.expr(d.sql_expr) for d in derived})
