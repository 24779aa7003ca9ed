"""Ontology operators: classes, abstract views, resolved relations, interfaces.

Metadata (classes, relations, maps) is a fixed list written by the modeller, so it is
handled as Python rows; only the node and edge frames are data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from kgspark.functions.ids import type_of


def descendants(classes: Sequence, name: str) -> dict[str, int]:
    """Class -> depth below ``name``, itself included at 0."""
    found, frontier, depth = {name: 0}, [name], 0
    while frontier:
        depth += 1
        frontier = [c.class_name for c in classes
                    if c.parent_class_name in frontier and c.class_name not in found]
        found.update(dict.fromkeys(frontier, depth))
    return found


def concrete_below(classes: Sequence, name: str) -> list:
    """Concrete classes at or below ``name``; each counted once."""
    below = descendants(classes, name)
    return [c for c in classes if c.class_name in below and not c.is_abstract]


def catalog_frame(spark: SparkSession, rows: Sequence, schema: str) -> DataFrame:
    """A metadata list as a frame. Its size is set by the modeller, not by the data."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def class_pairs(spark: SparkSession, classes: Sequence) -> DataFrame:
    rows = [(c.class_name, below, depth) for c in classes
            for below, depth in descendants(classes, c.class_name).items()]
    return spark.createDataFrame(rows, "ancestor_class string, descendant_class string, depth int")


def class_of_type(classes: Sequence, node_type):
    """Class name of a node type as a column expression over a fixed map."""
    pairs = [F.lit(x) for c in classes if not c.is_abstract for x in (c.node_type, c.class_name)]
    return F.element_at(F.create_map(*pairs), node_type)


def abstract_class_view(nodes: DataFrame, classes: Sequence, name: str) -> DataFrame:
    """Members of an abstract class with subtype and provenance, in one pass over the nodes."""
    members = concrete_below(classes, name)
    return nodes.where(F.col("node_type").isin([c.node_type for c in members])).select(
        F.col("node_id").alias("id"), class_of_type(members, F.col("node_type")).alias("subtype"),
        F.concat(F.lit("v_"), F.lower("node_type")).alias("src_view"))


def resolved_relations(edges: DataFrame, classes: Sequence, source: str = "EXPLICIT") -> DataFrame:
    """All relations in one schema with endpoint classes. Classes follow from the typed ids."""
    return edges.select(
        F.col("edge_type").alias("rel_name"), "src_id",
        class_of_type(classes, type_of("src_id")).alias("src_class"), "dst_id",
        class_of_type(classes, type_of("dst_id")).alias("dst_class"),
        "effective_start", "effective_end", "weight", F.lit(source).alias("source"))


def with_inferred(resolved: DataFrame, inferred: DataFrame, classes: Sequence) -> DataFrame:
    """Add inferred edges to the resolved relations, tagged by how they were inferred."""
    rows = inferred.select(
        "rel_name", "src_id", class_of_type(classes, type_of("src_id")).alias("src_class"),
        "dst_id", class_of_type(classes, type_of("dst_id")).alias("dst_class"),
        "effective_start", "effective_end", "weight", F.col("inference_kind").alias("source"))
    return resolved.unionByName(rows)


def abstract_relation_view(resolved: DataFrame, concrete: Sequence[str]) -> DataFrame:
    """Subset of the resolved relations under subject/object names."""
    return resolved.where(F.col("rel_name").isin(list(concrete))).select(
        F.col("rel_name").alias("via_rel"), F.col("src_id").alias("subject_id"),
        F.col("src_class").alias("subject_class"), F.col("dst_id").alias("object_id"),
        F.col("dst_class").alias("object_class"), "effective_start", "effective_end")


def generate_class_views(nodes: DataFrame, classes: Sequence, prefix: str = "ont_") -> dict[str, DataFrame]:
    """One temp view per abstract class, built from metadata."""
    views = {}
    for c in classes:
        if c.is_abstract:
            frame = abstract_class_view(nodes, classes, c.class_name)
            frame.createOrReplaceTempView(f"{prefix}{c.class_name.lower()}")
            views[c.class_name] = frame
    return views


def generate_relation_views(resolved: DataFrame, relation_map: Mapping[str, Sequence[str]],
                            prefix: str = "ont_") -> dict[str, DataFrame]:
    """One temp view per abstract relation, built from the relation map."""
    views = {}
    for name, concrete in relation_map.items():
        frame = abstract_relation_view(resolved, concrete).withColumn(
            "src_view", F.concat(F.lit("v_"), F.lower("via_rel")))
        frame.createOrReplaceTempView(f"{prefix}{name.lower()}")
        views[name] = frame
    return views


def interface_view(nodes: DataFrame, classes: Sequence, implementers: Sequence[str],
                   columns: Mapping[str, object]) -> DataFrame:
    """Members of every class implementing an interface, with its shared properties."""
    members = {c.class_name: c for name in implementers for c in concrete_below(classes, name)}
    rows = list(members.values())
    return nodes.where(F.col("node_type").isin([c.node_type for c in rows])).select(
        F.col("node_id").alias("id"), class_of_type(rows, F.col("node_type")).alias("class_name"),
        *[c.alias(name) for name, c in columns.items()])


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
