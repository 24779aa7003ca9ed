"""Constraint checks. Violation rows: check_name, scope, rel_or_class, src_id, dst_id, details."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from kgspark.functions.ids import raw_key
from kgspark.functions.intervals import active_as_of
from kgspark.functions.props import bounded_list, prop
from kgspark.session import cut_lineage

# fixed values: the texts of the violation log
MULTIPLE_EDGES = "Multiple edges from same source: "
MULTIPLE_EDGES_TO = "Multiple edges to same destination: "
EDGES = " edges"
NO_SOURCE = "Source node not found"
NO_DESTINATION = "Destination node not found"

ONE_PER_SOURCE = ("N:1", "1:1")
ONE_PER_DESTINATION = ("1:N", "1:1")


def check_cardinality(edges: DataFrame, rel: str, check_name: str, as_of) -> DataFrame:
    """Sources with more than one active edge of a relation."""
    return (edges.where(F.col("edge_type") == rel).where(active_as_of(as_of, end="effective_end"))
            .groupBy("src_id").agg(F.count("*").alias("n")).where("n > 1")
            .select(F.lit(check_name).alias("check_name"), F.lit("RELATION").alias("scope"),
                    F.lit(rel).alias("rel_or_class"), "src_id", F.lit(None).cast("string").alias("dst_id"),
                    F.concat(F.lit(MULTIPLE_EDGES), F.col("n").cast("string"), F.lit(EDGES)).alias("details")))


def counted_ends(edges: DataFrame, as_of) -> DataFrame:
    """(edge_type, side, id, n, active): how many edges, and active ones, of a relation have the id at this side.

    One narrow pass for all checks that ask about ends; an end of very many edges is combined before it is moved.
    """
    active = F.when(active_as_of(as_of, end="effective_end"), 1).otherwise(0)
    return edges.select("edge_type", active.alias("active"), F.explode(F.array(
        F.struct(F.lit("src").alias("side"), F.col("src_id").alias("id")),
        F.struct(F.lit("dst").alias("side"), F.col("dst_id").alias("id")))).alias("end")).groupBy(
        "edge_type", F.col("end.side").alias("side"), F.col("end.id").alias("id")).agg(
        F.count("*").alias("n"), F.sum("active").alias("active"))


def check_cardinality_all(edges: DataFrame, relations: Sequence, check_name: str, as_of, ends: DataFrame | None = None) -> DataFrame:
    """Both sides of every relation's declared cardinality in one grouped pass.

    ``ends``: ``counted_ends`` of the same edges and day, if at hand.
    """
    single_src = [r.rel_name for r in relations if r.cardinality in ONE_PER_SOURCE]
    single_dst = [r.rel_name for r in relations if r.cardinality in ONE_PER_DESTINATION]
    kind, is_src = F.col("edge_type"), F.col("side") == "src"
    if ends is None:
        ends = counted_ends(edges.where(kind.isin(single_src + single_dst)), as_of)
    return (ends.where((kind.isin(single_src) & is_src) | (kind.isin(single_dst) & ~is_src)).where("active > 1")
            .select(F.lit(check_name).alias("check_name"), F.lit("RELATION").alias("scope"),
                    F.col("edge_type").alias("rel_or_class"),
                    F.when(is_src, F.col("id")).alias("src_id"),
                    F.when(~is_src, F.col("id")).alias("dst_id"),
                    F.concat(F.when(is_src, MULTIPLE_EDGES).otherwise(MULTIPLE_EDGES_TO),
                             F.col("active").cast("string"), F.lit(EDGES)).alias("details")))


def check_referential(edges: DataFrame, nodes: DataFrame, check_name: str,
                      rel: str | None = None, splits: int = 256, ends: DataFrame | None = None) -> DataFrame:
    """One row per edge and missing endpoint. Ids are typed, so the join sees the node type.

    Endpoints are counted before they meet the nodes, so an endpoint is one row per relation in the join, whatever
    its edges; missing ones are spread out again afterwards, in up to ``splits`` parts. ``ends``: ``counted_ends``
    of the same edges, if at hand.
    """
    if ends is None:
        # only ids are needed here, and no day
        ends = edges.select("edge_type", F.explode(F.array(
            F.struct(F.lit("src").alias("side"), F.col("src_id").alias("id")),
            F.struct(F.lit("dst").alias("side"), F.col("dst_id").alias("id")))).alias("end")).groupBy(
            "edge_type", F.col("end.side").alias("side"), F.col("end.id").alias("id")).agg(F.count("*").alias("n"))
    counted = ends.select("edge_type", "side", "id", "n")
    if rel is not None:
        counted = counted.where(F.col("edge_type") == rel)
    known = nodes.select(F.col("node_id").alias("id"), F.lit(True).alias("known"))
    # an outer join, since an anti join would be copied into every branch of a union
    missing = counted.join(known, "id", "left").where("known IS NULL").withColumn(
        "part", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("n", F.lit(splits)))))
    share = F.expr(f"n div {splits} + if(part <= n % {splits}, 1, 0)")
    is_src = F.col("side") == "src"
    rows = missing.repartition("id", "part").select("edge_type", "id", "side", F.explode(F.sequence(F.lit(1).cast("bigint"), share)))
    return rows.select(
        F.lit(check_name).alias("check_name"), F.lit("RELATION").alias("scope"),
        F.col("edge_type").alias("rel_or_class"), F.when(is_src, F.col("id")).alias("src_id"),
        F.when(~is_src, F.col("id")).alias("dst_id"),
        F.when(is_src, NO_SOURCE).otherwise(NO_DESTINATION).alias("details"))


def class_intervals(tree: DataFrame, max_depth: int = 100) -> DataFrame:
    """(class_name, low, high) of rows (class_name, parent_class_name): a class is at or below another if its
    ``low`` lies in the other's interval. Labels are places in the order of paths from the root, and a class's
    interval ends with the last of those below it. A class on a circle or below an unknown parent raises."""
    paths = cut_lineage(tree.where("parent_class_name IS NULL").select("class_name", F.array("class_name").alias("path")))
    levels = [paths]
    for _ in range(max_depth):
        up = levels[-1].select(F.col("class_name").alias("parent_class_name"), "path")
        level = cut_lineage(tree.join(up, "parent_class_name").select("class_name", F.concat("path", F.array("class_name")).alias("path")))
        if level.isEmpty():
            break
        levels.append(level)
    paths = cut_lineage(reduce(DataFrame.unionByName, levels))
    if paths.count() != tree.count():
        raise ValueError("every class needs one way to a root")
    below = paths.select(F.explode("path").alias("class_name")).groupBy("class_name").agg(F.count("*").alias("size"))
    # one row per class: a catalog, not the data
    low = F.row_number().over(Window.orderBy("path")).cast("bigint")
    return paths.withColumn("low", low).join(below, "class_name").select(
        "class_name", "low", (F.col("low") + F.col("size") - 1).alias("high"))


def edge_classes(edges: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges with the classes of their end nodes, as the nodes have them: null for an unknown node, ``?`` for
    a node whose type has no class.

    ``nodes``: node_id, node_type; ``classes``: node_type, class_name.
    """
    known = nodes.join(F.broadcast(classes), "node_type", "left").select("node_id", F.coalesce("class_name", F.lit("?")).alias("class_name"))  # a catalog
    for side in ("src", "dst"):
        edges = edges.join(known.select(F.col("node_id").alias(f"{side}_id"), F.col("class_name").alias(f"{side}_class")), f"{side}_id", "left")
    return edges


def _labels(intervals: DataFrame, side: str, name: str) -> DataFrame:
    return F.broadcast(intervals.select(F.col("class_name").alias(name), F.col("low").alias(f"{side}_low"), F.col("high").alias(f"{side}_high")))


def _declared(relations: DataFrame, intervals: DataFrame) -> DataFrame:
    """(edge_type, domain_low, domain_high, range_low, range_high) of the catalog."""
    return (relations.join(_labels(intervals, "domain", "domain_class"), "domain_class")
            .join(_labels(intervals, "range", "range_class"), "range_class")
            .select(F.col("rel_name").alias("edge_type"), "domain_low", "domain_high", "range_low", "range_high"))


def _conforming(counted: DataFrame, relations: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows (edge_type, src_class, dst_class, ..) with conforms: both classes lie in the relation's intervals."""
    def labels(side, name):
        return _labels(intervals, side, name)

    declared = _declared(relations, intervals)
    rows = (counted.join(labels("s", "src_class"), "src_class", "left").join(labels("d", "dst_class"), "dst_class", "left")
            .join(F.broadcast(declared), "edge_type", "left"))
    fits = F.col("s_low").between(F.col("domain_low"), F.col("domain_high")) & F.col("d_low").between(F.col("range_low"), F.col("range_high"))
    return rows.withColumn("conforms", F.coalesce(fits, F.lit(False))).select(*counted.columns, "conforms")


def domain_range_profile(edges: DataFrame, nodes: DataFrame, classes: DataFrame, relations: DataFrame, intervals: DataFrame) -> DataFrame:
    """Edges per relation and classes of their end nodes, and whether they fit domain and range."""
    counted = edge_classes(edges.select("edge_type", "src_id", "dst_id"), nodes, classes).groupBy(
        "edge_type", "src_class", "dst_class").agg(F.count("*").alias("edges"))
    return _conforming(counted, relations, intervals)


def _unfit_ends(ends: DataFrame, nodes: DataFrame, classes: DataFrame, relations: DataFrame, intervals: DataFrame) -> DataFrame:
    """(edge_type, side, id) of known nodes whose class lies outside what the relation declares for the side."""
    known = nodes.join(F.broadcast(classes), "node_type", "left").select(F.col("node_id").alias("id"), "class_name")
    placed = (ends.select("edge_type", "side", "id").join(known, "id").join(_labels(intervals, "own", "class_name"), "class_name", "left")
              .join(F.broadcast(_declared(relations, intervals)), "edge_type", "left"))
    low = F.col("own_low")
    fits = F.when(F.col("side") == "src", low.between(F.col("domain_low"), F.col("domain_high"))).otherwise(
        low.between(F.col("range_low"), F.col("range_high")))
    return placed.where(~F.coalesce(fits, F.lit(False))).select("edge_type", "side", "id").distinct()


def check_domain_range(edges: DataFrame, nodes: DataFrame, classes: DataFrame, relations: DataFrame, intervals: DataFrame,
                       check_name: str, ends: DataFrame | None = None) -> DataFrame:
    """Edges whose end nodes fall outside the declared classes; unknown nodes are left to the referential check.

    Domain and range are looked at end by end first, one row per relation and end; only edges of an end that does
    not fit meet the nodes of both their ends. ``ends``: distinct (edge_type, side, id) of the edges, if at hand.
    """
    edges = edges.select("edge_type", "src_id", "dst_id")
    if ends is None:
        ends = edges.select("edge_type", F.explode(F.array(
            F.struct(F.lit("src").alias("side"), F.col("src_id").alias("id")),
            F.struct(F.lit("dst").alias("side"), F.col("dst_id").alias("id")))).alias("end")).select("edge_type", "end.*").distinct()
    unfit = cut_lineage(_unfit_ends(ends, nodes, classes, relations, intervals))  # mostly few, which only their size tells
    for side in ("src", "dst"):
        own = unfit.where(F.col("side") == side).select("edge_type", F.col("id").alias(f"{side}_id"), F.lit(True).alias(f"{side}_unfit"))
        edges = edges.join(own, ["edge_type", f"{side}_id"], "left")
    edges = edges.where("src_unfit OR dst_unfit").select("edge_type", "src_id", "dst_id")
    found = _conforming(edge_classes(edges, nodes, classes), relations, intervals)
    return found.where(~F.col("conforms") & F.col("src_class").isNotNull() & F.col("dst_class").isNotNull()).select(
        F.lit(check_name).alias("check_name"), F.lit("RELATION").alias("scope"),
        F.col("edge_type").alias("rel_or_class"), "src_id", "dst_id",
        F.lit("Endpoint class outside domain or range").alias("details"))


def unique_id_violations(nodes: DataFrame, check_name: str) -> DataFrame:
    """One row per id that several nodes carry."""
    return check_unique_ids(nodes).select(
        F.lit(check_name).alias("check_name"), F.lit("CLASS").alias("scope"), F.col("node_types").alias("rel_or_class"),
        F.col("id").alias("src_id"), F.lit(None).cast("string").alias("dst_id"),
        F.concat(F.lit("Id carried by "), F.col("nodes").cast("string"), F.lit(" nodes")).alias("details"))


def _property_rows(nodes: DataFrame, properties: Sequence) -> DataFrame:
    """One row per node and declared property: raw text and typed text of the value."""
    types = {}
    for p in properties:
        types.setdefault(p.node_type, []).append(p)
    cases = None
    for node_type, items in types.items():
        listed = F.array(*[F.struct(
            F.lit(p.prop_name).alias("prop_name"), F.lit(p.data_type).alias("data_type"),
            F.lit(p.is_required).alias("is_required"), prop(p.prop_name, "string").alias("raw"),
            prop(p.prop_name, p.data_type).cast("string").alias("typed")) for p in items])
        test = F.col("node_type") == node_type
        cases = F.when(test, listed) if cases is None else cases.when(test, listed)
    return (nodes.where(F.col("node_type").isin(list(types)))
            .select("node_id", "node_type", F.explode(cases).alias("p"))
            .select("node_id", "node_type", "p.*"))


def check_required_props(nodes: DataFrame, properties: Sequence, check_name: str) -> DataFrame:
    """Nodes lacking a required property or holding a value of another type."""
    rows = _property_rows(nodes, properties)
    missing = F.col("is_required") & F.col("raw").isNull()
    mistyped = F.col("raw").isNotNull() & F.col("typed").isNull()
    return rows.where(missing | mistyped).select(
        F.lit(check_name).alias("check_name"), F.lit("CLASS").alias("scope"),
        F.col("node_type").alias("rel_or_class"), F.col("node_id").alias("src_id"),
        F.lit(None).cast("string").alias("dst_id"),
        F.concat(F.when(missing, "Missing required property ").otherwise("Wrong type of property "),
                 F.col("prop_name")).alias("details"))


def property_profile(nodes: DataFrame, properties: Sequence) -> DataFrame:
    """Fill, distinct count and value range of every declared property.

    Values are combined before they are counted, so a frequent value costs one row.
    """
    values = (_property_rows(nodes, properties).groupBy("node_type", "prop_name", "data_type", "typed")
              .agg(F.count("*").alias("n")))
    text = F.when(F.col("data_type") != "double", F.col("typed"))
    return values.groupBy("node_type", "prop_name", "data_type").agg(
        F.sum("n").alias("nodes"),
        F.coalesce(F.sum(F.when(F.col("typed").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"),
        F.count("typed").alias("distinct_values"), F.min(text).alias("min_text"),
        F.max(text).alias("max_text"))


def check_unique_ids(nodes: DataFrame, typed: bool = True) -> DataFrame:
    """Ids carried by more than one node; with ``typed=False`` the bare keys, which collide
    across node types."""
    key = F.col("node_id") if typed else raw_key("node_id")
    return (nodes.groupBy(key.alias("id")).agg(F.count("*").alias("nodes"),
                                               bounded_list("node_type").alias("node_types"))
            .where("nodes > 1"))


def violation_summary(violations: DataFrame) -> DataFrame:
    """Violations per check; the texts are listed with their numbers blanked, which keeps
    the list as short as the set of message kinds."""
    return violations.groupBy("check_name", "scope", "rel_or_class").agg(
        F.count("*").alias("violation_count"),
        bounded_list(F.regexp_replace("details", "[0-9]+", "n"), "; ").alias("violation_types"))
