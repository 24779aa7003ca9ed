"""Typed ids: raw keys of different node types overlap, so an id is ``TYPE:key``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def typed_id(node_type: str, key: Column | str) -> Column:
    col = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(f"{node_type}:"), col.cast("string"))


def type_of(node_id: Column | str) -> Column:
    return F.substring_index(node_id, ":", 1)


def raw_key(node_id: Column | str) -> Column:
    return F.substring_index(node_id, ":", -1)


def edge_id(edge_type: Column, src: Column, dst: Column, start: Column) -> Column:
    """Content key of an edge: the same fact loaded twice gets the same id."""
    return F.sha2(F.concat_ws("|", edge_type, src, dst, start.cast("string")), 256)
