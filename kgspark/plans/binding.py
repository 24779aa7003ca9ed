"""The knowledge graph over the given tables.

Nodes: PART, CUSTOMER, SUPPLIER, ORDER, NATION, REGION.
Edges: SUPPLIED_BY part->supplier, BUYS_FROM customer->supplier, IN_ORDER part->order,
LEAD_SUPPLIER / TAIL_SUPPLIER supplier->order, WITHIN customer/supplier->nation->region.

The analytic queries work on the relation frames below (numeric keys, real columns);
typed string ids and property bags are added only where they are the output.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from kgspark.functions.ids import typed_id
from kgspark.session import cut_lineage, dealt
from kgspark.sources.ingest import LinkSource, ObjectSource, ingest_links, ingest_objects
from kgspark.sources.tables import Tables

AS_OF = dt.date(2001, 1, 1)          # the fixed "today" of all queries
OPEN_FROM = dt.date(2001, 6, 1)      # last activity on or after this day = still open


def price_cents():
    """Whole cents: sums are exact in any row order and stay in long arithmetic."""
    return F.floor(F.col("l_extendedprice") * 100 + 0.5)


def money(cents):
    """Cents as an amount."""
    return F.col(cents).cast("double") / 100 if isinstance(cents, str) else cents.cast("double") / 100


def _open_or(day):
    last = F.max(day).cast("date")
    return F.when(last < F.lit(OPEN_FROM), last)


def line_rows(t: Tables) -> int | None:
    """How many lines there are, None of tables that cannot tell."""
    rows = getattr(t, "rows", None)
    return rows and rows("lineitem")


def supplied_by(t: Tables) -> DataFrame:
    """One row per (part, supplier). A pair has few lines, so lines are dealt to as many tasks as they ask for
    instead of being combined first; days and cents take less room on the way than times and doubles."""
    lines = t.lineitem.select("l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("day"), price_cents().alias("line_cents"))
    return dealt(lines, line_rows(t), "l_partkey", "l_suppkey").groupBy(
        F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key")).agg(
        F.min("day").alias("start_date"),
        _open_or(F.col("day")).alias("end_date"),
        F.sum("line_cents").alias("cents"),
        F.count("*").alias("lines"))


def order_supplier(t: Tables) -> DataFrame:
    """Lines of each order combined per supplier before any join with orders, where the order lies."""
    lines = dealt(t.lineitem.select("l_orderkey", "l_suppkey", price_cents().alias("line_cents")), line_rows(t), "l_orderkey")
    return lines.groupBy(F.col("l_orderkey").alias("order_key"), F.col("l_suppkey").alias("supp_key")).agg(
        F.sum("line_cents").alias("cents"),
        F.count("*").alias("lines"))


def buys_from(t: Tables) -> DataFrame:
    placed = t.orders.select(F.col("o_orderkey").alias("order_key"),
                             F.col("o_custkey").alias("cust_key"), F.col("o_orderdate").cast("date").alias("day"))
    rows = line_rows(t)
    bought = order_supplier(t).join(dealt(placed, rows, "order_key"), "order_key")
    return dealt(bought.select("cust_key", "supp_key", "day", "cents", "lines"), rows, "cust_key", "supp_key").groupBy("cust_key", "supp_key").agg(
        F.min("day").alias("start_date"),
        _open_or(F.col("day")).alias("end_date"),
        F.sum("cents").alias("cents"), F.sum("lines").alias("lines"))


def in_order(t: Tables, by: tuple[str, ...] = ("l_partkey", "l_orderkey")) -> DataFrame:
    """One row per (part, order): quantity and lines by return flag. Lines lie ``by`` these, one or both."""
    flag = F.col("l_returnflag")
    # whole hundredths add up exactly; the fraction goes after the sum
    hundredths = F.floor(F.col("l_quantity") * 100 + 0.5).alias("hundredths")
    lines = dealt(t.lineitem.select("l_partkey", "l_orderkey", hundredths, "l_returnflag"), line_rows(t), *by)
    return lines.groupBy(F.col("l_partkey").alias("part_key"), F.col("l_orderkey").alias("order_key")).agg(
        F.floor(F.sum("hundredths") / 100).cast("bigint").alias("quantity"),
        F.count_if(flag == "R").alias("returned"),
        F.count_if(flag == "A").alias("accepted"),
        F.count_if(flag == "N").alias("not_returned"))


def order_dim(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("cust_key"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total_price"), "o_orderdate")


def order_sides(t: Tables, rows: int | None = None) -> DataFrame:
    """Lead and tail supplier of every order with lines, and what each delivered.

    The lead has the smallest (line number, supplier key), the tail the largest. Rows are
    combined per (order, supplier) first: an order with very many lines is reduced before
    its rows meet on the order key. With ``rows``, the number of lines, lines are dealt by order
    instead, and both steps are done where the order lies.
    """
    lines = dealt(t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", price_cents().alias("line_cents")), rows, "l_orderkey")
    per_supplier = lines.groupBy("l_orderkey", "l_suppkey").agg(
        F.min("l_linenumber").alias("first_line"), F.max("l_linenumber").alias("last_line"),
        F.sum("line_cents").alias("cents"))
    return per_supplier.groupBy(F.col("l_orderkey").alias("order_key")).agg(
        F.min(F.struct("first_line", "l_suppkey", "cents")).alias("lead"),
        F.max(F.struct("last_line", "l_suppkey", "cents")).alias("tail")).select(
        "order_key", F.col("lead.l_suppkey").alias("lead_key"), F.col("tail.l_suppkey").alias("tail_key"),
        F.col("lead.cents").alias("lead_cents"), F.col("tail.cents").alias("tail_cents"))


def matchups(t: Tables) -> DataFrame:
    """Orders where two different suppliers meet."""
    return order_sides(t).where("lead_key <> tail_key")


def geography(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"))


def supplier_dim(t: Tables) -> DataFrame:
    return t.supplier.withColumnRenamed("s_nationkey", "nation_key").join(
        geography(t), "nation_key").select(
        F.col("s_suppkey").alias("supp_key"), F.col("s_name").alias("supplier_name"),
        "nation", "region")


def customer_dim(t: Tables) -> DataFrame:
    return t.customer.withColumnRenamed("c_nationkey", "nation_key").join(
        geography(t), "nation_key").select(
        F.col("c_custkey").alias("cust_key"), F.col("c_name").alias("customer_name"),
        F.col("nation").alias("origin"), F.col("region").alias("home_region"),
        F.col("c_mktsegment").alias("segment"))


def part_dim(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("part_key"), F.col("p_name").alias("part_name"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("part_type"),
        F.col("p_size").alias("part_size"), F.col("p_retailprice").alias("retail_price"))


def engaged_with(t: Tables) -> DataFrame:
    """Abstract relation party -> organisation: SUPPLIED_BY and BUYS_FROM in one schema."""
    cols = ["role", "party_key", "supp_key", "via_rel", "start_date", "end_date", "cents"]
    parts = supplied_by(t).select(
        F.lit("Part").alias("role"), F.col("part_key").alias("party_key"), "supp_key",
        F.lit("SUPPLIED_BY").alias("via_rel"), "start_date", "end_date", "cents")
    customers = buys_from(t).select(
        F.lit("Customer").alias("role"), F.col("cust_key").alias("party_key"), "supp_key",
        F.lit("BUYS_FROM").alias("via_rel"), "start_date", "end_date", "cents")
    return parts.select(cols).unionByName(customers.select(cols))


def party_dim(t: Tables) -> DataFrame:
    """Abstract class Party: parts and customers with the attribute each subtype calls origin."""
    parts = part_dim(t).select(
        F.lit("Part").alias("role"), F.col("part_key").alias("party_key"),
        F.col("part_name").alias("party_name"), F.col("brand").alias("origin"),
        F.lit(None).cast("string").alias("home_region"))
    customers = customer_dim(t).select(
        F.lit("Customer").alias("role"), F.col("cust_key").alias("party_key"),
        F.col("customer_name").alias("party_name"), "origin", "home_region")
    return parts.unionByName(customers)


def party_id():
    return F.concat(F.upper("role"), F.lit(":"), F.col("party_key").cast("string"))


def party_engagements(t: Tables) -> DataFrame:
    """Engagements with the party's and the supplier's attributes."""
    return (engaged_with(t).join(party_dim(t), ["role", "party_key"])
            .join(supplier_dim(t), "supp_key"))


# --- the universal node and edge frames --------------------------------------------------

OBJECT_SOURCES = [
    ObjectSource("PART", "part", "p_partkey", "p_name", {
        "type": "p_type", "brand": "p_brand", "size": "p_size", "retail_price": "p_retailprice"}),
    ObjectSource("CUSTOMER", "customer", "c_custkey", "c_name", {
        "nation": "n_name", "segment": "c_mktsegment", "balance": "c_acctbal"}),
    ObjectSource("SUPPLIER", "supplier", "s_suppkey", "s_name", {
        "nation": "n_name", "region": "r_name", "balance": "s_acctbal"}),
    ObjectSource("ORDER", "orders", "o_orderkey", "concat('Order ', o_orderkey)", {
        "order_date": "cast(o_orderdate as date)", "priority": "o_orderpriority",
        "status": "o_orderstatus", "lead_supplier": "lead_key", "tail_supplier": "tail_key"},
        ingested="o_orderdate"),
    ObjectSource("NATION", "nation", "n_nationkey", "n_name", {"region": "r_name"}),
    ObjectSource("REGION", "region", "r_regionkey", "r_name"),
]

LINK_SOURCES = [
    LinkSource("SUPPLIED_BY", "supplied_by", "PART", "part_key", "SUPPLIER", "supp_key",
               "start_date", "end_date", {"value": "cast(cents as decimal(20,0)) / 100", "lines": "lines"}),
    LinkSource("BUYS_FROM", "buys_from", "CUSTOMER", "cust_key", "SUPPLIER", "supp_key",
               "start_date", "end_date", {"value": "cast(cents as decimal(20,0)) / 100", "lines": "lines"}),
    LinkSource("IN_ORDER", "in_order", "PART", "part_key", "ORDER", "order_key",
               "order_date", "order_date", {
                   "quantity": "quantity", "returned": "returned", "accepted": "accepted",
                   "not_returned": "not_returned"}),
    LinkSource("LEAD_SUPPLIER", "order_sides", "SUPPLIER", "supp_key", "ORDER", "order_key",
               "order_date", props={"value": "cast(cents as decimal(20,0)) / 100"}, where="side = 'lead'"),
    LinkSource("TAIL_SUPPLIER", "order_sides", "SUPPLIER", "supp_key", "ORDER", "order_key",
               "order_date", props={"value": "cast(cents as decimal(20,0)) / 100"}, where="side = 'tail'"),
    LinkSource("WITHIN", "customer", "CUSTOMER", "c_custkey", "NATION", "c_nationkey"),
    LinkSource("WITHIN", "supplier", "SUPPLIER", "s_suppkey", "NATION", "s_nationkey"),
    LinkSource("WITHIN", "nation", "NATION", "n_nationkey", "REGION", "n_regionkey"),
]


def object_frames(t: Tables) -> dict[str, DataFrame]:
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return {
        "part": t.part, "region": t.region, "nation": nations,
        "customer": t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")),
        "supplier": t.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey")),
        "orders": t.orders.join(order_sides(t), F.col("o_orderkey") == F.col("order_key"), "left"),
    }


def sides_in_rows(sides: DataFrame) -> DataFrame:
    """(order_key, order_date, side, supp_key, cents), two rows per order. Lead and tail edges read the same
    columns of the same rows, so the shuffles behind them are made once for both."""
    return sides.select("order_key", "order_date", F.explode(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(f"{side}_key").alias("supp_key"), F.col(f"{side}_cents").alias("cents"))
        for side in ("lead", "tail")])).alias("s")).select("order_key", "order_date", "s.*")


def link_frames(t: Tables) -> dict[str, DataFrame]:
    rows = line_rows(t)
    # orders and the lines of each lie together: what is grouped per order meets its date in place
    dated = dealt(order_dim(t).select("order_key", "order_date"), rows, "order_key")
    return {
        "supplied_by": supplied_by(t), "buys_from": buys_from(t),
        "in_order": in_order(t, ("l_orderkey",)).join(dated, "order_key"),
        "order_sides": sides_in_rows(order_sides(t, rows).join(dated, "order_key")),
        "customer": t.customer, "supplier": t.supplier, "nation": t.nation,
    }


def kg_nodes(t: Tables) -> DataFrame:
    """All nodes. A filter on node_type prunes the other sources at planning time."""
    return ingest_objects(object_frames(t), OBJECT_SOURCES)


def kg_edges(t: Tables) -> DataFrame:
    """All edges. A filter on edge_type prunes the other sources at planning time."""
    return ingest_links(link_frames(t), LINK_SOURCES)


def written_edges(t: Tables, kinds: set[str] | None = None) -> DataFrame:
    """The edges without their property bags, derived and written once for everything that reads them several
    times. Each file holds edges of one source, so that a filter on edge_type skips the others. With ``kinds``
    only edges of these types, if that is all that will be read."""
    name = "edges" if kinds is None else f"edges {sorted(kinds)}"
    if name not in t.written:
        edges = kg_edges(t) if kinds is None else kg_edges(t).where(F.col("edge_type").isin(sorted(kinds)))
        t.written[name] = cut_lineage(edges.select("src_id", "dst_id", "edge_type", "weight", "effective_start", "effective_end"), packed=True)
    return t.written[name]


def node_keys(t: Tables) -> DataFrame:
    """(node_id, node_type) only: no joins, no property bags."""
    sources = {"PART": (t.part, "p_partkey"), "CUSTOMER": (t.customer, "c_custkey"),
               "SUPPLIER": (t.supplier, "s_suppkey"), "ORDER": (t.orders, "o_orderkey"),
               "NATION": (t.nation, "n_nationkey"), "REGION": (t.region, "r_regionkey")}
    frames = [df.select(typed_id(kind, key).alias("node_id"), F.lit(kind).alias("node_type"))
              for kind, (df, key) in sources.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
