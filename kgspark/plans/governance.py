"""Catalog questions, answered with live counts from the node and edge frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kgspark.functions.props import prop
from kgspark.operators import inference as inf, ontology as ont, quality as q
from kgspark.plans import binding as b, metadata as md
from kgspark.plans.checks import sql
from kgspark.plans.ontology import ALL_INFERRED_SQL, CLASS_SQL, derived_values
from kgspark.plans.registry import query
from kgspark.sources.tables import Tables


def text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    """A catalog list as a SQL VALUES table."""
    body = ", ".join("(" + ", ".join(
        str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else text(v) for v in r) + ")"
        for r in rows)
    return f"SELECT * FROM (VALUES {body}) v({columns})"


TYPE_COUNTS = {"tc": "SELECT node_type, COUNT(*) AS n FROM node_keys GROUP BY node_type"}


def type_counts(t: Tables) -> DataFrame:
    return b.node_keys(t).groupBy("node_type").agg(F.count("*").alias("n"))


def class_members(t: Tables) -> DataFrame:
    """(class_name, instances) with abstract classes holding all their descendants."""
    rows = [(c.class_name, below.node_type) for c in md.CLASSES
            for below in ont.concrete_below(md.CLASSES, c.class_name)]
    pairs = t.spark.createDataFrame(rows, "class_name string, node_type string")
    return (pairs.join(type_counts(t), "node_type", "left").groupBy("class_name")
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("instances")))


MEMBER_CTES = {**TYPE_COUNTS,
               "members": """SELECT class_name, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS instances FROM ({}) p
                    LEFT JOIN tc ON tc.node_type = p.node_type GROUP BY class_name""".format(
                   values([(c.class_name, x.node_type) for c in md.CLASSES
                           for x in ont.concrete_below(md.CLASSES, c.class_name)], "class_name, node_type"))}


@query("ontology_overview", sql(f"""
    SELECT '{md.ONTOLOGY}' AS ontology_name, '{md.VERSION}' AS version, {len(md.CLASSES)} AS object_types,
           {len(md.RELATIONS)} AS link_types, {len(md.PROPERTIES)} AS properties,
           {len(md.INTERFACES)} AS interfaces, {len(md.ACTIONS)} AS actions,
           (SELECT COUNT(*) FROM node_keys) AS live_nodes, (SELECT COUNT(*) FROM edges) AS live_edges,
           (SELECT COUNT(*) FROM i) AS inferred_edges""", "node_keys", "edges", extra={"i": ALL_INFERRED_SQL}))
def ontology_overview(t: Tables) -> DataFrame:
    """Independent one-row aggregates as scalar subqueries; nothing is multiplied."""
    def count(df):
        return df.agg(F.count("*").alias("n")).scalar()
    one = t.spark.range(1)
    return one.select(
        F.lit(md.ONTOLOGY).alias("ontology_name"), F.lit(md.VERSION).alias("version"),
        F.lit(len(md.CLASSES)).alias("object_types"), F.lit(len(md.RELATIONS)).alias("link_types"),
        F.lit(len(md.PROPERTIES)).alias("properties"), F.lit(len(md.INTERFACES)).alias("interfaces"),
        F.lit(len(md.ACTIONS)).alias("actions"), count(b.node_keys(t)).alias("live_nodes"),
        count(b.kg_edges(t)).alias("live_edges"), count(inf.infer_all(b.kg_edges(t), md.RULES, md.RELATION_MAP)).alias("inferred_edges"))


def _class_rows():
    rows = []
    for c in md.CLASSES:
        names = sorted(p.prop_name for p in md.PROPERTIES if p.class_name == c.class_name)
        rows.append((c.class_name, c.parent_class_name, c.is_abstract, c.description, len(names),
                     ", ".join(names) or None))
    return rows


CLASS_COLS = "object_type, parent_class_name, is_abstract, description, property_count, properties"


@query("class_catalog", sql("SELECT c.*, instances FROM c JOIN members m ON m.class_name = c.object_type",
                            "node_keys", extra={**MEMBER_CTES, "c": values(_class_rows(), CLASS_COLS)}))
def class_catalog(t: Tables) -> DataFrame:
    catalog = t.spark.createDataFrame(_class_rows(), "object_type string, parent_class_name string, "
                                      "is_abstract boolean, description string, property_count int, properties string")
    members = class_members(t).withColumnRenamed("class_name", "object_type")
    return catalog.join(members, "object_type")


REL_ROWS = [(r.rel_name, r.domain_class, r.range_class, r.cardinality, r.is_hierarchical, r.inverse_rel_name)
            for r in md.RELATIONS if not r.is_abstract]
REL_COLS = "link_type, from_object_type, to_object_type, cardinality, is_hierarchical, inverse_rel_name"


@query("relation_catalog", sql("""
    SELECT r.*, e.edges, o.max_out, i.max_in FROM r
    LEFT JOIN (SELECT edge_type, COUNT(*) AS edges FROM edges GROUP BY 1) e ON e.edge_type = link_type
    LEFT JOIN (SELECT edge_type, MAX(n) AS max_out FROM (SELECT edge_type, src_id, COUNT(*) n FROM edges
               GROUP BY 1, 2) GROUP BY 1) o ON o.edge_type = link_type
    LEFT JOIN (SELECT edge_type, MAX(n) AS max_in FROM (SELECT edge_type, dst_id, COUNT(*) n FROM edges
               GROUP BY 1, 2) GROUP BY 1) i ON i.edge_type = link_type""", "edges",
                               extra={"r": values(REL_ROWS, REL_COLS)}))
def relation_catalog(t: Tables) -> DataFrame:
    """Declared cardinality next to the observed one; one pass, a hot endpoint is one counted row."""
    ends = b.kg_edges(t).select("edge_type", F.explode(F.array(
        F.struct(F.lit(True).alias("out"), F.col("src_id").alias("id")),
        F.struct(F.lit(False).alias("out"), F.col("dst_id").alias("id")))).alias("end"))
    counts = (ends.groupBy(F.col("edge_type").alias("link_type"), "end.out", "end.id")
              .agg(F.count("*").alias("n")).groupBy("link_type").agg(
        F.sum(F.when(F.col("out"), F.col("n"))).alias("edges"),
        F.max(F.when(F.col("out"), F.col("n"))).alias("max_out"),
        F.max(F.when(~F.col("out"), F.col("n"))).alias("max_in")))
    catalog = t.spark.createDataFrame(REL_ROWS, "link_type string, from_object_type string, "
                                      "to_object_type string, cardinality string, is_hierarchical boolean, "
                                      "inverse_rel_name string")
    return catalog.join(counts, "link_type", "left")


def _profile_sql() -> str:
    """One aggregate per declared property of the check's own tables."""
    source = {("PART", "type"): ("part", "p_type"), ("PART", "brand"): ("part", "p_brand"),
              ("PART", "size"): ("part", "p_size"), ("PART", "retail_price"): ("part", "p_retailprice"),
              ("CUSTOMER", "nation"): ("customer_dim", "origin"), ("CUSTOMER", "segment"): ("customer_dim", "segment"),
              ("CUSTOMER", "balance"): ("customer", "c_acctbal"), ("SUPPLIER", "nation"): ("supplier_dim", "nation"),
              ("SUPPLIER", "region"): ("supplier_dim", "region"), ("SUPPLIER", "balance"): ("supplier", "s_acctbal"),
              ("ORDER", "order_date"): ("order_dim", "order_date"), ("ORDER", "priority"): ("order_dim", "priority"),
              ("ORDER", "status"): ("order_dim", "status"), ("ORDER", "lead_supplier"): ("sided", "lead_key"),
              ("ORDER", "tail_supplier"): ("sided", "tail_key"),
              ("NATION", "region"): ("(SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey)", "r_name")}
    parts = []
    for p in md.PROPERTIES:
        table, col = source[(p.node_type, p.prop_name)]
        low, high = ((f"MIN(CAST({col} AS VARCHAR))", f"MAX(CAST({col} AS VARCHAR))") if p.data_type != "double"
                     else ("CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"))
        parts.append(f"""SELECT '{p.node_type}' AS node_type, '{p.prop_name}' AS prop_name,
            '{p.data_type}' AS data_type, COUNT(*) AS nodes, COUNT({col}) AS filled,
            COUNT(DISTINCT {col}) AS distinct_values, {low} AS min_text, {high} AS max_text FROM {table}""")
    return " UNION ALL ".join(parts)


@query("property_profile", sql(_profile_sql(), "customer_dim", "supplier_dim", "order_dim", "lead_tail", extra={
    "sided": "SELECT o.order_key, lead_key, tail_key FROM order_dim o LEFT JOIN lead_tail l ON l.order_key = o.order_key"}))
def property_profile(t: Tables) -> DataFrame:
    return q.property_profile(b.kg_nodes(t), md.PROPERTIES)


def _interface_rows():
    return [(name, text_, ", ".join(sorted(md.INTERFACE_IMPL[name])), len(md.INTERFACE_IMPL[name]))
            for name, text_ in md.INTERFACES.items()]


def _interface_types():
    return sorted({(name, c.node_type) for name, impl in md.INTERFACE_IMPL.items() for cls in impl
                   for c in ont.concrete_below(md.CLASSES, cls)})


INTERFACE_COLS = "interface_name, description, implementing_classes, implementation_count"


@query("interface_counts", sql("""
    SELECT i.*, x.instances FROM i JOIN (
      SELECT interface_name, CAST(SUM(n) AS BIGINT) AS instances FROM it JOIN tc ON tc.node_type = it.node_type
      GROUP BY interface_name) x ON x.interface_name = i.interface_name""", "node_keys", extra={
        **TYPE_COUNTS, "i": values(_interface_rows(), INTERFACE_COLS),
        "it": values(_interface_types(), "interface_name, node_type")}))
def interface_counts(t: Tables) -> DataFrame:
    catalog = t.spark.createDataFrame(_interface_rows(), "interface_name string, description string, "
                                      "implementing_classes string, implementation_count int")
    types = t.spark.createDataFrame(_interface_types(), "interface_name string, node_type string")
    live = types.join(type_counts(t), "node_type").groupBy("interface_name").agg(F.sum("n").alias("instances"))
    return catalog.join(live, "interface_name")


def _action_rows():
    rows = []
    for a in md.ACTIONS:
        params = sorted((p for p in md.ACTION_PARAMS if p.action_id == a.action_id), key=lambda p: p.param_name)
        listed = "; ".join(f"{p.param_name} ({p.param_type}{', required' if p.is_required else ''})" for p in params)
        rows.append((a.target_class, a.action_name, a.is_enabled, len(params), listed or None))
    return rows


ACTION_COLS = "object_type, action_name, is_enabled, parameter_count, parameters"


@query("action_catalog", sql("""
    SELECT a.*, m.instances AS eligible FROM a JOIN members m ON m.class_name = a.object_type WHERE is_enabled""",
                             "node_keys", extra={**MEMBER_CTES, "a": values(_action_rows(), ACTION_COLS)}))
def action_catalog(t: Tables) -> DataFrame:
    catalog = t.spark.createDataFrame(_action_rows(), "object_type string, action_name string, "
                                      "is_enabled boolean, parameter_count int, parameters string")
    live = class_members(t).select(F.col("class_name").alias("object_type"), F.col("instances").alias("eligible"))
    return catalog.where("is_enabled").join(live, "object_type")


BINDING_COLS = "function_name, version, bound_kind, bound_name"


@query("function_catalog", sql("""
    SELECT f.function_name, f.version, bound_kind, bound_name,
           (SELECT COUNT(DISTINCT x.bound_name) FROM f x WHERE x.function_name = f.function_name
              AND x.version = f.version) AS binding_count,
           COALESCE(m.instances, e.n) AS bound_rows
    FROM f LEFT JOIN members m ON bound_kind = 'OBJECT_TYPE' AND m.class_name = bound_name
    LEFT JOIN (SELECT edge_type, COUNT(*) AS n FROM edges GROUP BY 1) e
      ON bound_kind = 'LINK_TYPE' AND e.edge_type = bound_name""", "node_keys", "edges", extra={
        **MEMBER_CTES, "f": values(md.FUNCTION_BINDINGS, BINDING_COLS)}))
def function_catalog(t: Tables) -> DataFrame:
    """Registered functions, what they are bound to and how many rows that holds."""
    bound = t.spark.createDataFrame(md.FUNCTION_BINDINGS, "function_name string, version string, "
                                    "bound_kind string, bound_name string")
    counts = bound.groupBy("function_name", "version").agg(F.count_distinct("bound_name").alias("binding_count"))
    edges = b.kg_edges(t).groupBy("edge_type").agg(F.count("*").alias("bound_rows"))
    live = class_members(t).select(F.lit("OBJECT_TYPE").alias("bound_kind"), F.col("class_name").alias("bound_name"),
                                   F.col("instances").alias("bound_rows")).unionByName(
        edges.select(F.lit("LINK_TYPE").alias("bound_kind"), F.col("edge_type").alias("bound_name"), "bound_rows"))
    return bound.join(counts, ["function_name", "version"]).join(live, ["bound_kind", "bound_name"], "left")


def _role_rows():
    rows = []
    for role, description in md.ROLES.items():
        own = [p for p in md.PERMISSIONS if p.role == role]
        kinds = [len({p.subject_name for p in own if p.subject_kind == k})
                 for k in ("OBJECT_TYPE", "LINK_TYPE", "ACTION_TYPE")]
        rows.append((role, description, *kinds, ", ".join(sorted({p.privilege for p in own}))))
    return rows


def _role_reads():
    types = md.concrete_types()
    return ([(role, "NODE", types[name]) for role in md.ROLES for name in md.grants(role, "OBJECT_TYPE")]
            + [(role, "EDGE", name) for role in md.ROLES for name in md.grants(role, "LINK_TYPE")])


ROLE_COLS = "role, role_description, object_types, link_types, actions, privileges"


@query("role_access_matrix", sql("""
    SELECT r.*, CAST(COALESCE(SUM(n.n), 0) AS BIGINT) AS nodes_readable,
           CAST(COALESCE(SUM(e.n), 0) AS BIGINT) AS edges_readable
    FROM r LEFT JOIN g ON g.role = r.role LEFT JOIN tc n ON g.kind = 'NODE' AND n.node_type = g.element
    LEFT JOIN (SELECT edge_type, COUNT(*) AS n FROM edges GROUP BY 1) e ON g.kind = 'EDGE' AND e.edge_type = g.element
    GROUP BY ALL""", "node_keys", "edges", extra={
        **TYPE_COUNTS, "r": values(_role_rows(), ROLE_COLS), "g": values(_role_reads(), "role, kind, element")}))
def role_access_matrix(t: Tables) -> DataFrame:
    roles = t.spark.createDataFrame(_role_rows(), "role string, role_description string, object_types int, "
                                    "link_types int, actions int, privileges string")
    reads = t.spark.createDataFrame(_role_reads(), "role string, kind string, element string")
    counts = type_counts(t).select(F.lit("NODE").alias("kind"), F.col("node_type").alias("element"), "n").unionByName(
        b.kg_edges(t).groupBy(F.lit("EDGE").alias("kind"), F.col("edge_type").alias("element")).agg(
            F.count("*").alias("n")))
    held = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    seen = reads.join(counts, ["kind", "element"]).groupBy("role").agg(
        held("NODE").alias("nodes_readable"), held("EDGE").alias("edges_readable"))
    zero = F.lit(0).cast("bigint")
    return roles.join(seen, "role", "left").withColumns({
        "nodes_readable": F.coalesce("nodes_readable", zero),
        "edges_readable": F.coalesce("edges_readable", zero)})


@query("nodes_visible_to_role", sql("""SELECT node_id, node_type FROM node_keys
    WHERE node_type IN ('PART', 'SUPPLIER', 'ORDER')""", "node_keys"))
def nodes_visible_to_role(t: Tables, role: str = "VIEWER") -> DataFrame:
    """Row filter: nodes whose class the role may read."""
    types = md.concrete_types()
    return b.node_keys(t).where(F.col("node_type").isin([types[c] for c in md.grants(role, "OBJECT_TYPE")]))


@query("object_view", """
    SELECT 'PART:' || p_partkey AS node_id, 'PART' AS node_type,
           p_name || ' | ' || p_type || ' | ' || p_brand AS display FROM part
    UNION ALL SELECT 'CUSTOMER:' || c_custkey, 'CUSTOMER', c_name || ' | ' || n_name || ' | ' || c_mktsegment
              FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'SUPPLIER:' || s_suppkey, 'SUPPLIER', s_name || ' | ' || r_name || ' | ' || n_name
              FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'ORDER:' || o_orderkey, 'ORDER', 'Order ' || o_orderkey || ' | ' ||
              CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' | ' || o_orderpriority FROM orders""")
def object_view(t: Tables) -> DataFrame:
    """Every node through its class's display columns."""
    shown = None
    for node_type, cols in md.DISPLAY_COLS.items():
        line = F.concat_ws(" | ", *[F.col("name") if c == "name" else prop(c, "string") for c in cols])
        test = F.col("node_type") == node_type
        shown = F.when(test, line) if shown is None else shown.when(test, line)
    return b.kg_nodes(t).where(F.col("node_type").isin(list(md.DISPLAY_COLS))).select(
        "node_id", "node_type", shown.alias("display"))
