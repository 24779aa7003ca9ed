"""Ingest, typed views and enriched views of the graph."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from kgspark.functions.ids import typed_id
from kgspark.functions.intervals import active_as_of, in_year
from kgspark.functions.props import prop, props_text
from kgspark.operators import actions, views
from kgspark.plans import binding as b, metadata as md
from kgspark.plans.checks import AS_OF, active, sql
from kgspark.plans.registry import query
from kgspark.session import checkpoint_dir
from kgspark.sources import json_arrays
from kgspark.sources.ingest import edges_from_props, tag_by_role
from kgspark.sources.tables import Tables


@query("kg_ingest_nodes", """
    SELECT 'PART:' || p_partkey AS node_id, 'PART' AS node_type, p_name AS name, p_brand AS label,
           DATE '1995-01-01' AS ingested FROM part
    UNION ALL SELECT 'CUSTOMER:' || c_custkey, 'CUSTOMER', c_name, c_mktsegment, DATE '1995-01-01' FROM customer
    UNION ALL SELECT 'SUPPLIER:' || s_suppkey, 'SUPPLIER', s_name, r_name, DATE '1995-01-01'
              FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'ORDER:' || o_orderkey, 'ORDER', 'Order ' || o_orderkey, o_orderpriority,
              CAST(o_orderdate AS DATE) FROM orders
    UNION ALL SELECT 'NATION:' || n_nationkey, 'NATION', n_name, r_name, DATE '1995-01-01'
              FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'REGION:' || r_regionkey, 'REGION', r_name, NULL, DATE '1995-01-01' FROM region""")
def kg_ingest_nodes(t: Tables) -> DataFrame:
    label = F.coalesce(*[prop(p, "string") for p in ("brand", "segment", "region", "priority")])
    return b.kg_nodes(t).select("node_id", "node_type", "name", label.alias("label"),
                                F.col("ts_ingested").cast("date").alias("ingested"))


@query("kg_ingest_edges", sql("""
    SELECT SHA256(CONCAT_WS('|', edge_type, e.src_id, e.dst_id, CAST(effective_start AS VARCHAR))) AS edge_id,
           edge_type, e.src_id, e.dst_id, CAST(1.0 AS DOUBLE) AS weight, effective_start, effective_end
    FROM edges e""", "edges"))
def kg_ingest_edges(t: Tables) -> DataFrame:
    return b.kg_edges(t).select("edge_id", "edge_type", "src_id", "dst_id", "weight",
                                "effective_start", "effective_end")


@query("kg_edges_from_props", sql("""
    SELECT 'LT_' || 'ORDER:' || l.order_key AS edge_id, 'SUPPLIER:' || lead_key AS src_id,
           'ORDER:' || l.order_key AS dst_id, 'LEAD_SUPPLIER' AS edge_type, order_date AS effective_start
    FROM lead_tail l JOIN order_dim o ON o.order_key = l.order_key
    UNION ALL
    SELECT 'TT_' || 'ORDER:' || l.order_key, 'SUPPLIER:' || tail_key, 'ORDER:' || l.order_key,
           'TAIL_SUPPLIER', order_date
    FROM lead_tail l JOIN order_dim o ON o.order_key = l.order_key""", "lead_tail", "order_dim"))
def kg_edges_from_props(t: Tables) -> DataFrame:
    links = {"LEAD_SUPPLIER": ("lead_supplier", "LT_"), "TAIL_SUPPLIER": ("tail_supplier", "TT_")}
    return edges_from_props(b.kg_nodes(t), "ORDER", links, "order_date", "SUPPLIER")


@query("kg_node_counts", sql("SELECT node_type, COUNT(*) AS nodes FROM node_keys GROUP BY node_type",
                             "node_keys"))
def kg_node_counts(t: Tables) -> DataFrame:
    return b.node_keys(t).groupBy("node_type").agg(F.count("*").alias("nodes"))


@query("kg_edge_counts", sql("SELECT edge_type, COUNT(*) AS edges FROM edges GROUP BY edge_type", "edges"))
def kg_edge_counts(t: Tables) -> DataFrame:
    return b.kg_edges(t).groupBy("edge_type").agg(F.count("*").alias("edges"))


@query("props_extract", """
    SELECT event_type, COUNT(*) AS events, COUNT(CAST(props->>'$.k' AS BIGINT)) AS with_k,
           SUM(CAST(props->>'$.k' AS BIGINT))::BIGINT AS sum_k, MAX(CAST(props->>'$.k' AS BIGINT)) AS max_k
    FROM events GROUP BY event_type""")
def props_extract(t: Tables) -> DataFrame:
    """Semi-structured text: parsed once, read by path with a cast that never fails the job."""
    parsed = t.events.select("event_type", F.try_parse_json("props").alias("props"))
    k = parsed.select("event_type", prop("k", "bigint").alias("k"))
    return k.groupBy("event_type").agg(
        F.count("*").alias("events"), F.count("k").alias("with_k"), F.sum("k").alias("sum_k"),
        F.max("k").alias("max_k"))


# --- typed views -------------------------------------------------------------------------

@query("v_part", """SELECT 'PART:' || p_partkey AS node_id, p_name AS name, p_type AS type,
    p_brand AS brand, p_size AS size, p_retailprice AS retail_price FROM part""")
def v_part(t: Tables) -> DataFrame:
    return views.entity_view(b.kg_nodes(t), "PART", {
        "type": "string", "brand": "string", "size": "int", "retail_price": "double"})


@query("v_customer", """SELECT 'CUSTOMER:' || c_custkey AS node_id, c_name AS name, n_name AS nation,
    c_mktsegment AS segment, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def v_customer(t: Tables) -> DataFrame:
    return views.entity_view(b.kg_nodes(t), "CUSTOMER", {
        "nation": "string", "segment": "string", "balance": "double"})


@query("v_supplier", """SELECT 'SUPPLIER:' || s_suppkey AS node_id, s_name AS name, n_name AS nation,
    r_name AS region, s_acctbal AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey""")
def v_supplier(t: Tables) -> DataFrame:
    return views.entity_view(b.kg_nodes(t), "SUPPLIER", {
        "nation": "string", "region": "string", "balance": "double"})


V_ORDER_SQL = sql("""SELECT 'ORDER:' || o.order_key AS node_id, 'Order ' || o.order_key AS name,
    order_date, priority, status, lead_key AS lead_supplier, tail_key AS tail_supplier
    FROM order_dim o LEFT JOIN lead_tail l ON l.order_key = o.order_key""", "order_dim", "lead_tail")


@query("v_order", V_ORDER_SQL)
def v_order(t: Tables) -> DataFrame:
    return views.entity_view(b.kg_nodes(t), "ORDER", {
        "order_date": "date", "priority": "string", "status": "string",
        "lead_supplier": "bigint", "tail_supplier": "bigint"})


@query("typed_view_from_properties", V_ORDER_SQL)
def typed_view_from_properties(t: Tables) -> DataFrame:
    """The order view again, generated from the declared property rows."""
    declared = [p for p in md.PROPERTIES if p.node_type == "ORDER"]
    return views.declared_view(b.kg_nodes(t), "ORDER", declared)


TENURE_PROPS = {"value": "double", "lines": "bigint"}


def _tenure_sql(relation: str, src: str, src_type: str, key: str) -> str:
    return sql(f"""SELECT '{src_type}:' || {key} AS {src}, 'SUPPLIER:' || supp_key AS supplier_id,
        start_date AS effective_start, end_date AS effective_end, CAST(value AS DOUBLE) AS value, lines
        FROM {relation}""", relation)


@query("v_supplied_by", _tenure_sql("supplied_by", "part_id", "PART", "part_key"))
def v_supplied_by(t: Tables) -> DataFrame:
    return views.relation_view(b.kg_edges(t), "SUPPLIED_BY", "part_id", "supplier_id", TENURE_PROPS)


@query("v_buys_from", _tenure_sql("buys_from", "customer_id", "CUSTOMER", "cust_key"))
def v_buys_from(t: Tables) -> DataFrame:
    return views.relation_view(b.kg_edges(t), "BUYS_FROM", "customer_id", "supplier_id", TENURE_PROPS)


@query("v_in_order", sql("""SELECT 'PART:' || part_key AS part_id, 'ORDER:' || i.order_key AS order_id,
    order_date AS effective_start, order_date AS effective_end, quantity, returned, accepted, not_returned
    FROM in_order i JOIN order_dim o ON o.order_key = i.order_key""", "in_order", "order_dim"))
def v_in_order(t: Tables) -> DataFrame:
    return views.relation_view(b.kg_edges(t), "IN_ORDER", "part_id", "order_id", dict.fromkeys(
        ("quantity", "returned", "accepted", "not_returned"), "bigint"))


def _side_sql(side: str) -> str:
    return sql(f"""SELECT 'SUPPLIER:' || {side}_key AS supplier_id, 'ORDER:' || s.order_key AS order_id,
        order_date AS effective_start, CAST(NULL AS DATE) AS effective_end,
        CAST({side}_value AS DOUBLE) AS value
        FROM order_sides s JOIN order_dim o ON o.order_key = s.order_key""", "order_sides", "order_dim")


@query("v_lead_supplier", _side_sql("lead"))
def v_lead_supplier(t: Tables) -> DataFrame:
    return views.relation_view(b.kg_edges(t), "LEAD_SUPPLIER", "supplier_id", "order_id", {"value": "double"})


@query("v_tail_supplier", _side_sql("tail"))
def v_tail_supplier(t: Tables) -> DataFrame:
    return views.relation_view(b.kg_edges(t), "TAIL_SUPPLIER", "supplier_id", "order_id", {"value": "double"})


# --- predicates and enriched views ---------------------------------------------------------

@query("edges_active_as_of", sql(f"""
    SELECT SHA256(CONCAT_WS('|', edge_type, src_id, dst_id, CAST(effective_start AS VARCHAR))) AS edge_id,
           src_id, dst_id, edge_type, effective_start, effective_end FROM edges
    WHERE effective_end IS NULL OR effective_end >= {AS_OF}""", "edges"))
def edges_active_as_of(t: Tables) -> DataFrame:
    return b.kg_edges(t).where(active_as_of(b.AS_OF, end="effective_end")).select(
        "edge_id", "src_id", "dst_id", "edge_type", "effective_start", "effective_end")


@query("orders_in_year", """
    SELECT 'ORDER:' || o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date,
           o_orderpriority AS priority, o_totalprice AS total_price
    FROM orders WHERE YEAR(o_orderdate) = 1998""")
def orders_in_year(t: Tables, year: int = 1998) -> DataFrame:
    return b.order_dim(t).where(in_year("o_orderdate", year)).select(
        typed_id("ORDER", "order_key").alias("order_id"), "order_date", "priority", "total_price")


@query("order_results", sql("""
    SELECT 'ORDER:' || o.order_key AS order_id, order_date, l.supplier_name AS lead_supplier,
           t.supplier_name AS tail_supplier, CAST(lead_value AS DOUBLE) AS lead_value,
           CAST(tail_value AS DOUBLE) AS tail_value,
           CASE WHEN lead_value > tail_value THEN 'LEAD_WIN'
                WHEN lead_value < tail_value THEN 'TAIL_WIN' ELSE 'DRAW' END AS result
    FROM order_dim o LEFT JOIN order_sides s ON s.order_key = o.order_key
    LEFT JOIN supplier_dim l ON l.supp_key = lead_key
    LEFT JOIN supplier_dim t ON t.supp_key = tail_key""", "order_dim", "order_sides", "supplier_dim"))
def order_results(t: Tables) -> DataFrame:
    from kgspark.plans.concrete import named_sides
    rows = b.order_dim(t).select("order_key", "order_date").join(b.order_sides(t), "order_key", "left")
    lead, tail = F.col("lead_cents"), F.col("tail_cents")
    return named_sides(t, rows, "left").select(
        typed_id("ORDER", "order_key").alias("order_id"), "order_date", "lead_supplier",
        "tail_supplier", b.money(lead).alias("lead_value"), b.money(tail).alias("tail_value"),
        F.when(lead > tail, "LEAD_WIN").when(lead < tail, "TAIL_WIN").otherwise("DRAW").alias("result"))


@query("active_parts", sql(f"""
    SELECT 'PART:' || p.part_key AS part_id, part_name, brand, part_type, supplier_name, nation,
           start_date, end_date
    FROM part_dim p JOIN supplied_by e ON e.part_key = p.part_key
    JOIN supplier_dim s ON s.supp_key = e.supp_key WHERE {active()}""",
                           "part_dim", "supplied_by", "supplier_dim"))
def active_parts(t: Tables) -> DataFrame:
    return (b.supplied_by(t).where(active_as_of(b.AS_OF)).join(b.part_dim(t), "part_key")
            .join(b.supplier_dim(t), "supp_key")
            .select(typed_id("PART", "part_key").alias("part_id"), "part_name", "brand", "part_type",
                    "supplier_name", "nation", "start_date", "end_date"))


@query("active_customers", sql(f"""
    SELECT 'CUSTOMER:' || c.cust_key AS customer_id, customer_name, origin, segment, supplier_name,
           nation, start_date, end_date
    FROM customer_dim c JOIN buys_from e ON e.cust_key = c.cust_key
    JOIN supplier_dim s ON s.supp_key = e.supp_key WHERE {active()}""",
                               "customer_dim", "buys_from", "supplier_dim"))
def active_customers(t: Tables) -> DataFrame:
    return (b.buys_from(t).where(active_as_of(b.AS_OF)).join(b.customer_dim(t), "cust_key")
            .join(b.supplier_dim(t), "supp_key")
            .select(typed_id("CUSTOMER", "cust_key").alias("customer_id"), "customer_name", "origin",
                    "segment", "supplier_name", "nation", "start_date", "end_date"))


@query("rel_resolved_props", sql("""
    SELECT 'SUPPLIED_BY' AS rel_name, 'PART:' || part_key AS src_id, 'SUPPLIER:' || supp_key AS dst_id,
           CASE WHEN end_date IS NULL THEN '{"lines":' || lines || '}'
                ELSE '{"lines":' || lines || ',"last":"' || end_date || '"}' END AS props_json
    FROM supplied_by
    UNION ALL
    SELECT 'BUYS_FROM', 'CUSTOMER:' || cust_key, 'SUPPLIER:' || supp_key,
           CASE WHEN end_date IS NULL THEN '{"lines":' || lines || '}'
                ELSE '{"lines":' || lines || ',"last":"' || end_date || '"}' END
    FROM buys_from
    UNION ALL
    SELECT 'IN_ORDER', 'PART:' || part_key, 'ORDER:' || i.order_key, '{"last":"' || order_date || '","quantity":' || quantity
           || ',"returned":' || returned || ',"accepted":' || accepted || ',"not_returned":' || not_returned || '}'
    FROM in_order i JOIN order_dim o ON o.order_key = i.order_key
    UNION ALL
    SELECT 'LEAD_SUPPLIER', 'SUPPLIER:' || lead_key, 'ORDER:' || order_key, '{"cents":' || CAST(ROUND(lead_value * 100) AS BIGINT) || '}'
    FROM order_sides
    UNION ALL
    SELECT 'TAIL_SUPPLIER', 'SUPPLIER:' || tail_key, 'ORDER:' || order_key, '{"cents":' || CAST(ROUND(tail_value * 100) AS BIGINT) || '}'
    FROM order_sides
    UNION ALL
    SELECT edge_type, src_id, dst_id, '{}' FROM edges WHERE edge_type = 'WITHIN'""",
                                 "supplied_by", "buys_from", "in_order", "order_dim", "order_sides", "edges"))
def rel_resolved_props(t: Tables) -> DataFrame:
    """Property object rebuilt from typed columns, for every relation; an unset key is left out."""
    numbers = ("quantity", "returned", "accepted", "not_returned")
    typed = b.kg_edges(t).select(
        F.col("edge_type").alias("rel_name"), "src_id", "dst_id", "effective_end", prop("lines", "bigint").alias("lines"),
        F.when(F.col("edge_type").isin("LEAD_SUPPLIER", "TAIL_SUPPLIER"),
               (prop("value", "decimal(20,2)") * 100).cast("bigint")).alias("cents"),
        *[prop(name, "bigint").alias(name) for name in numbers])
    return typed.select("rel_name", "src_id", "dst_id", props_text(
        lines=F.col("lines"), last=F.col("effective_end"), cents=F.col("cents"),
        **{name: F.col(name) for name in numbers}).alias("props_json"))


# --- lineage of the configured sources ------------------------------------------------------

@query("source_mapped_objects", sql("""
    SELECT node_type, CASE node_type WHEN 'PART' THEN 'part' WHEN 'CUSTOMER' THEN 'customer'
           WHEN 'SUPPLIER' THEN 'supplier' WHEN 'ORDER' THEN 'orders' WHEN 'NATION' THEN 'nation'
           ELSE 'region' END AS source,
           CASE node_type WHEN 'PART' THEN 4 WHEN 'CUSTOMER' THEN 3 WHEN 'SUPPLIER' THEN 3
           WHEN 'ORDER' THEN 5 WHEN 'NATION' THEN 1 ELSE 0 END AS mapped_properties,
           COUNT(*) AS mapped_rows FROM node_keys GROUP BY node_type""", "node_keys"))
def source_mapped_objects(t: Tables) -> DataFrame:
    """Rows each configured object source maps into the node frame."""
    return _lineage(b.kg_nodes(t), "node_type", [
        (s.node_type, s.source, len(s.props)) for s in b.OBJECT_SOURCES])


@query("source_mapped_links", sql("""
    SELECT edge_type, CASE edge_type WHEN 'SUPPLIED_BY' THEN 'supplied_by' WHEN 'BUYS_FROM' THEN 'buys_from'
           WHEN 'IN_ORDER' THEN 'in_order' WHEN 'WITHIN' THEN 'customer, nation, supplier'
           ELSE 'order_sides' END AS source,
           CASE edge_type WHEN 'SUPPLIED_BY' THEN 2 WHEN 'BUYS_FROM' THEN 2 WHEN 'IN_ORDER' THEN 4
           WHEN 'WITHIN' THEN 0 ELSE 1 END AS mapped_properties,
           COUNT(*) AS mapped_rows FROM edges GROUP BY edge_type""", "edges"))
def source_mapped_links(t: Tables) -> DataFrame:
    specs: dict[str, tuple[set, int]] = {}
    for s in b.LINK_SOURCES:
        names, _ = specs.setdefault(s.edge_type, (set(), len(s.props)))
        names.add(s.source)
    return _lineage(b.kg_edges(t), "edge_type", [
        (kind, ", ".join(sorted(names)), n) for kind, (names, n) in specs.items()])


def _lineage(df: DataFrame, kind: str, specs: list[tuple[str, str, int]]) -> DataFrame:
    listed = df.sparkSession.createDataFrame(specs, f"{kind} string, source string, mapped_properties int")
    return df.groupBy(kind).agg(F.count("*").alias("mapped_rows")).join(listed, kind).select(
        kind, "source", "mapped_properties", "mapped_rows")


@query("coverage_profile", sql("""
    SELECT 'NODE' AS kind, node_type AS element, COUNT(*) AS rows_held, MIN(d) AS first_date,
           MAX(d) AS last_date, 0 AS open_rows, CAST(node_type = 'REGION' AS DOUBLE) AS null_props_share
    FROM (SELECT node_type, CASE WHEN node_type = 'ORDER' THEN order_date ELSE DATE '1995-01-01' END AS d
          FROM node_keys LEFT JOIN order_dim ON node_id = 'ORDER:' || order_key) GROUP BY node_type
    UNION ALL
    SELECT 'EDGE', edge_type, COUNT(*), MIN(effective_start), MAX(effective_start),
           COUNT(*) FILTER (effective_end IS NULL), CAST(edge_type = 'WITHIN' AS DOUBLE) FROM edges GROUP BY edge_type""",
                               "node_keys", "order_dim", "edges"))
def coverage_profile(t: Tables) -> DataFrame:
    """Time covered, row counts, open rows and share of rows without properties per node and edge type."""
    bare = (F.count_if(F.col("props").isNull()) / F.count("*")).alias("null_props_share")
    day = F.col("ts_ingested").cast("date")
    nodes = b.kg_nodes(t).groupBy(F.lit("NODE").alias("kind"), F.col("node_type").alias("element")).agg(
        F.count("*").alias("rows_held"), F.min(day).alias("first_date"), F.max(day).alias("last_date"),
        F.lit(0).cast("bigint").alias("open_rows"), bare)
    edges = b.kg_edges(t).groupBy(F.lit("EDGE").alias("kind"), F.col("edge_type").alias("element")).agg(
        F.count("*").alias("rows_held"), F.min("effective_start").alias("first_date"),
        F.max("effective_start").alias("last_date"),
        F.count_if(F.col("effective_end").isNull()).alias("open_rows"), bare)
    return nodes.unionByName(edges)


@query("apply_moves", sql("""
    SELECT 'PART:' || r.part_key AS part_id, 'SUPPLIER:' || from_key AS from_supplier,
           'SUPPLIER:' || to_key AS to_supplier,
           CASE WHEN from_key = to_key THEN 'SAME_SUPPLIER'
                WHEN f.part_key IS NULL THEN 'NO_OPEN_TENURE' ELSE 'APPLIED' END AS status,
           CASE WHEN from_key <> to_key AND f.part_key IS NOT NULL THEN DATE '2001-12-01' END AS move_date
    FROM req r LEFT JOIN supplied_by f ON f.part_key = r.part_key AND f.supp_key = r.from_key
      AND f.end_date IS NULL AND f.start_date <= DATE '2001-12-01'""", "supplied_by", extra={
        "req": """SELECT part_key, MAX(supp_key) AS from_key, MIN(supp_key) AS to_key
                  FROM supplied_by GROUP BY part_key"""}))
def apply_moves(t: Tables) -> DataFrame:
    """Requests to move every part from its last to its first supplier, accepted or rejected."""
    tenures = b.supplied_by(t).select("part_key", "supp_key", "start_date", "end_date")
    return actions.decide_moves(tenures, _move_requests(tenures), "part_key", "supp_key").select(
        typed_id("PART", "part_key").alias("part_id"), typed_id("SUPPLIER", "from_key").alias("from_supplier"),
        typed_id("SUPPLIER", "to_key").alias("to_supplier"), "status",
        F.when(F.col("status") == "APPLIED", F.col("move_date")).alias("move_date"))


def _move_requests(tenures: DataFrame) -> DataFrame:
    return tenures.groupBy("part_key").agg(
        F.max("supp_key").alias("from_key"), F.min("supp_key").alias("to_key")).withColumn(
        "move_date", F.lit(dt.date(2001, 12, 1)))


MOVED_SQL = """SELECT r.part_key, from_key, to_key FROM req r JOIN supplied_by f ON f.part_key = r.part_key
    AND f.supp_key = r.from_key AND f.end_date IS NULL AND f.start_date <= DATE '2001-12-01' WHERE from_key <> to_key"""


@query("tenures_after_moves", sql("""
    SELECT 'PART:' || part_key AS part_id, 'SUPPLIER:' || supp_key AS supplier_id, start_date, end_date,
           CAST(ROW_NUMBER() OVER (PARTITION BY part_key, supp_key ORDER BY start_date, end_date) AS INT) AS tenure
    FROM (SELECT e.part_key, supp_key, start_date,
                 CASE WHEN e.end_date IS NULL AND m.part_key IS NOT NULL THEN DATE '2001-12-01' ELSE e.end_date END AS end_date
          FROM supplied_by e LEFT JOIN m ON m.part_key = e.part_key AND m.from_key = e.supp_key
          UNION ALL
          SELECT part_key, to_key, DATE '2001-12-01', NULL FROM m WHERE NOT EXISTS (
              SELECT 1 FROM supplied_by o WHERE o.part_key = m.part_key AND o.supp_key = m.to_key AND o.end_date IS NULL))""",
                                  "supplied_by", extra={
        "req": "SELECT part_key, MAX(supp_key) AS from_key, MIN(supp_key) AS to_key FROM supplied_by GROUP BY part_key",
        "m": MOVED_SQL}))
def tenures_after_moves(t: Tables) -> DataFrame:
    """All tenures once the accepted moves of ``apply_moves`` took effect."""
    tenures = b.supplied_by(t).select("part_key", "supp_key", "start_date", "end_date")
    decided = actions.decide_moves(tenures, _move_requests(tenures), "part_key", "supp_key")
    return actions.apply_moves(tenures, decided, "part_key", "supp_key").select(
        typed_id("PART", "part_key").alias("part_id"), typed_id("SUPPLIER", "supp_key").alias("supplier_id"),
        "start_date", "end_date", "tenure")


REPLAY_CTES = {
    "req": "SELECT part_key, MAX(supp_key) AS from_key, MIN(supp_key) AS to_key FROM supplied_by GROUP BY part_key",
    "m": MOVED_SQL,
    "o": """SELECT part_key, supp_key, start_date FROM supplied_by e WHERE end_date IS NULL
              AND NOT EXISTS (SELECT 1 FROM m WHERE m.part_key = e.part_key AND m.from_key = e.supp_key)
            UNION ALL SELECT part_key, to_key, DATE '2001-12-01' FROM m WHERE NOT EXISTS (
              SELECT 1 FROM supplied_by o WHERE o.part_key = m.part_key AND o.supp_key = m.to_key AND o.end_date IS NULL)""",
    "n": """SELECT r.part_key, r.to_key AS from_key, r.from_key + 1 AS to_key,
              CASE WHEN o.part_key IS NOT NULL THEN 'APPLIED'
                   WHEN m.part_key IS NOT NULL AND m.from_key = r.to_key THEN 'SUPERSEDED' ELSE 'NO_OPEN_TENURE' END AS status
            FROM req r LEFT JOIN o ON o.part_key = r.part_key AND o.supp_key = r.to_key LEFT JOIN m ON m.part_key = r.part_key"""}


@query("moves_replayed", sql("""
    SELECT 'PART:' || r.part_key AS part_id, 'SUPPLIER:' || r.from_key AS from_supplier, 'SUPPLIER:' || r.to_key AS to_supplier,
           DATE '2001-12-01' AS move_date, CASE WHEN r.from_key = r.to_key THEN 'SAME_SUPPLIER'
                WHEN m.part_key IS NULL THEN 'NO_OPEN_TENURE' ELSE 'APPLIED' END AS status
    FROM req r LEFT JOIN m ON m.part_key = r.part_key
    UNION ALL SELECT 'PART:' || part_key, 'SUPPLIER:' || from_key, 'SUPPLIER:' || to_key, DATE '2001-12-15', status FROM n""",
                             "supplied_by", extra=REPLAY_CTES))
def moves_replayed(t: Tables) -> DataFrame:
    """Two requests per part in one batch, the second from where the first leads: every outcome in time order."""
    decided, _ = actions.replay_moves(*_replayed(t), "part_key", "supp_key")
    return decided.select(typed_id("PART", "part_key").alias("part_id"), typed_id("SUPPLIER", "from_key").alias("from_supplier"),
                          typed_id("SUPPLIER", "to_key").alias("to_supplier"), "move_date", "status")


def _replayed(t: Tables) -> tuple[DataFrame, DataFrame]:
    tenures = b.supplied_by(t).select("part_key", "supp_key", "start_date", "end_date")
    there = _move_requests(tenures)
    on = there.select("part_key", F.col("to_key").alias("from_key"), (F.col("from_key") + 1).alias("to_key"),
                      F.lit(dt.date(2001, 12, 15)).alias("move_date"))
    return tenures, there.unionByName(on)


@query("tenures_replayed", sql("""
    SELECT 'PART:' || part_key AS part_id, 'SUPPLIER:' || supp_key AS supplier_id, start_date, end_date FROM (
        SELECT part_key, supp_key, start_date, end_date FROM supplied_by WHERE end_date IS NOT NULL
        UNION ALL SELECT e.part_key, supp_key, start_date, DATE '2001-12-01' FROM supplied_by e
            JOIN m ON m.part_key = e.part_key AND m.from_key = e.supp_key WHERE end_date IS NULL
        UNION ALL SELECT o.part_key, supp_key, start_date, CASE WHEN n.part_key IS NOT NULL THEN DATE '2001-12-15' END
            FROM o LEFT JOIN n ON n.part_key = o.part_key AND n.from_key = o.supp_key AND n.status = 'APPLIED'
        UNION ALL SELECT part_key, to_key, DATE '2001-12-15', NULL FROM n WHERE status = 'APPLIED' AND NOT EXISTS (
            SELECT 1 FROM o WHERE o.part_key = n.part_key AND o.supp_key = n.to_key))""", "supplied_by", extra=REPLAY_CTES))
def tenures_replayed(t: Tables) -> DataFrame:
    """All tenures after the requests of ``moves_replayed``."""
    _, after = actions.replay_moves(*_replayed(t), "part_key", "supp_key")
    return after.select(typed_id("PART", "part_key").alias("part_id"), typed_id("SUPPLIER", "supp_key").alias("supplier_id"),
                        "start_date", "end_date")


@query("tenures_after_engaging", sql("""
    SELECT 'PART:' || part_key AS part_id, 'SUPPLIER:' || supp_key AS supplier_id, start_date, end_date FROM supplied_by
    UNION ALL
    SELECT 'PART:' || p_partkey, 'SUPPLIER:1', DATE '2001-12-01', NULL FROM part
    WHERE p_partkey NOT IN (SELECT part_key FROM supplied_by WHERE supp_key = 1 AND end_date IS NULL)""", "supplied_by"))
def tenures_after_engaging(t: Tables, supplier: int = 1) -> DataFrame:
    """All tenures once every part without an open one there is engaged with one supplier."""
    tenures = b.supplied_by(t).select("part_key", "supp_key", "start_date", "end_date")
    requests = t.part.select(F.col("p_partkey").alias("part_key"), F.lit(supplier).cast("bigint").alias("supp_key"),
                             F.lit(dt.date(2001, 12, 1)).alias("start_date"))
    return actions.engage(tenures, requests, "part_key", "supp_key").select(
        typed_id("PART", "part_key").alias("part_id"), typed_id("SUPPLIER", "supp_key").alias("supplier_id"),
        "start_date", "end_date")


@query("orders_after_recording", """
    SELECT o_orderkey AS order_key, o_orderstatus AS status FROM orders
    UNION ALL SELECT -o_orderkey - 1, 'R' FROM orders WHERE o_orderstatus = 'F'""")
def orders_after_recording(t: Tables) -> DataFrame:
    """Orders with one newly recorded counterpart per finished order; results for known orders change nothing."""
    known = t.orders.select(F.col("o_orderkey").alias("order_key"), F.col("o_orderstatus").alias("status"))
    fresh = known.where("status = 'F'").select((-F.col("order_key") - 1).alias("order_key"), F.lit("R").alias("status"))
    return actions.record(known, known.withColumn("status", F.lit("X")).unionByName(fresh), "order_key")


STAGED_PERSON = T.StructType([T.StructField("key", T.LongType()), T.StructField("name", T.StringType()), T.StructField("role", T.StringType()),
                              T.StructField("motto", T.StringType()), T.StructField("balance", T.DoubleType())])
STAGED_CLUB = T.StructType([T.StructField("key", T.LongType()), T.StructField("name", T.StringType()),
                            T.StructField("place", T.StructType([T.StructField("nation", T.LongType())]))])


def _stage(t: Tables) -> tuple[str, str]:
    """Customers and suppliers as JSON arrays in the checkpoint folder, some of them broken or without a name."""
    folder = f"{checkpoint_dir(t.spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    person = F.to_json(F.struct(F.col("c_custkey").alias("key"), F.when(F.col("c_nationkey") != 3, F.col("c_name")).alias("name"),
                                F.col("c_mktsegment").alias("role"), F.concat(F.lit('"{'), "c_name", F.lit("}\\")).alias("motto"),
                                F.col("c_acctbal").alias("balance")))
    broken = F.when(F.col("c_acctbal") < 0, F.regexp_replace(person, '"role":', '"role"')).otherwise(person)
    club = F.to_json(F.struct(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
                              F.struct(F.col("s_nationkey").alias("nation")).alias("place")))
    json_arrays.write_arrays(t.customer.select(broken.alias("record")), f"{folder}/persons")
    json_arrays.write_arrays(t.supplier.select(club.alias("record")), f"{folder}/clubs")
    return f"{folder}/persons", f"{folder}/clubs"


@query("staged_load", """
    SELECT 'person' AS source, UPPER(c_mktsegment) AS kind, 'LOADED' AS outcome, COUNT(*) AS records FROM customer
    WHERE c_acctbal >= 0 AND c_nationkey <> 3 GROUP BY 2
    UNION ALL SELECT 'person', NULL, 'MALFORMED', COUNT(*) FROM customer WHERE c_acctbal < 0 HAVING COUNT(*) > 0
    UNION ALL SELECT 'person', NULL, 'MISSING name', COUNT(*) FROM customer WHERE c_acctbal >= 0 AND c_nationkey = 3 HAVING COUNT(*) > 0
    UNION ALL SELECT 'club', 'CLUB', 'LOADED', COUNT(*) FROM supplier""")
def staged_load(t: Tables) -> DataFrame:
    """Staged JSON arrays of persons, tagged by role, and of clubs: how many records loaded and how many did not, and why."""
    persons, clubs = _stage(t)
    loaded, rejected = json_arrays.load_records(json_arrays.array_records(t.spark, persons), STAGED_PERSON, ("key", "name", "role"))
    shape = {"name": F.col("name"), "motto": F.col("motto"), "balance": F.col("balance")}
    # roles have property shapes of their own, so they are a modeller's list
    roles = [r.role for r in t.customer.select(F.upper("c_mktsegment").alias("role")).distinct().collect()]
    nodes = tag_by_role(loaded, F.col("role"), dict.fromkeys(roles, shape), F.col("key"), F.col("name"), F.lit(None).cast("string"))
    good, bad = json_arrays.load_records(json_arrays.array_records(t.spark, clubs), STAGED_CLUB, ("key", "name", "place"))
    rows = reduce(DataFrame.union, [
        nodes.select(F.lit("person").alias("source"), F.col("node_type").alias("kind"), F.lit("LOADED").alias("outcome")),
        rejected.select(F.lit("person"), F.lit(None).cast("string"), "reason"),
        good.select(F.lit("club"), F.lit("CLUB"), F.lit("LOADED")), bad.select(F.lit("club"), F.lit(None).cast("string"), "reason")])
    return rows.groupBy("source", "kind", "outcome").agg(F.count("*").alias("records"))
