"""Questions on the concrete model: parts, suppliers, orders and their tenures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from kgspark.functions.ids import typed_id
from kgspark.functions.intervals import active_as_of, in_year, tenure_days
from kgspark.functions.props import bounded_list, round_ratio
from kgspark.operators import moves
from kgspark.plans import binding as b
from kgspark.plans.checks import AS_OF, active, ratio2, sql
from kgspark.plans.registry import query
from kgspark.session import cut_lineage
from kgspark.sources.tables import Tables

YEAR = 1998
SINCE = dt.date(2000, 1, 1)
PERFORMANCE_SINCE = dt.datetime(1998, 1, 1)
SIDES = "lead_key", "tail_key"


def part_id(col="part_key"):
    return typed_id("PART", col)


def supplier_id(col="supp_key"):
    return typed_id("SUPPLIER", col)


def order_id(col="order_key"):
    return typed_id("ORDER", col)


def winner():
    return (F.when(F.col("lead_cents") > F.col("tail_cents"), F.col("lead_supplier"))
            .when(F.col("tail_cents") > F.col("lead_cents"), F.col("tail_supplier"))
            .otherwise("Draw"))


WINNER_SQL = ("CASE WHEN lead_value > tail_value THEN l.supplier_name "
              "WHEN tail_value > lead_value THEN t.supplier_name ELSE 'Draw' END")


def named_sides(t: Tables, sides: DataFrame, how: str = "inner") -> DataFrame:
    dim = b.supplier_dim(t)
    lead = dim.select(F.col("supp_key").alias("lead_key"), F.col("supplier_name").alias("lead_supplier"))
    tail = dim.select(F.col("supp_key").alias("tail_key"), F.col("supplier_name").alias("tail_supplier"))
    return sides.join(lead, "lead_key", how).join(tail, "tail_key", how)


def assortment(t: Tables, supplier_name: str | None = None, as_of=b.AS_OF) -> DataFrame:
    """Parts a supplier currently delivers; all suppliers when none is named."""
    suppliers = b.supplier_dim(t)
    if supplier_name is not None:
        suppliers = suppliers.where(F.col("supplier_name") == supplier_name)
    return (b.supplied_by(t).where(active_as_of(as_of))
            .join(b.part_dim(t), "part_key").join(suppliers, "supp_key")
            .select("supplier_name", part_id().alias("part_id"), "part_name", "brand", "part_type",
                    "lines", "start_date"))


@query("current_assortment", sql(f"""
    SELECT supplier_name, 'PART:' || p.part_key AS part_id, part_name, brand, part_type, lines,
           start_date
    FROM supplied_by e JOIN part_dim p ON p.part_key = e.part_key
    JOIN supplier_dim s ON s.supp_key = e.supp_key WHERE {active()}""",
                                 "supplied_by", "part_dim", "supplier_dim"))
def current_assortment(t: Tables) -> DataFrame:
    return assortment(t)


@query("supplier_performance", sql("""
    SELECT supplier_name, COUNT(*) AS total_orders, CAST(SUM(lead_value) AS DOUBLE) AS total_value,
           CAST(SUM(lead_value) AS DOUBLE) / COUNT(*) AS avg_value,
           COUNT(*) FILTER (lead_value > tail_value) AS wins,
           COUNT(*) FILTER (lead_value = tail_value) AS draws,
           COUNT(*) FILTER (lead_value < tail_value) AS losses
    FROM order_sides m JOIN order_dim o ON o.order_key = m.order_key
    JOIN supplier_dim s ON s.supp_key = lead_key WHERE YEAR(order_date) = 1998
    GROUP BY supplier_name""", "order_sides", "order_dim", "supplier_dim"))
def supplier_performance(t: Tables, year: int = YEAR) -> DataFrame:
    """Every order counts for its lead; one supplier on both sides is a draw with itself."""
    placed = b.order_dim(t).where(in_year("o_orderdate", year)).select("order_key")
    scored = (b.order_sides(t).join(placed, "order_key").groupBy("lead_key").agg(
        F.count("*").alias("total_orders"), F.sum("lead_cents").alias("_cents"),
        F.count_if(F.col("lead_cents") > F.col("tail_cents")).alias("wins"),
        F.count_if(F.col("lead_cents") == F.col("tail_cents")).alias("draws"),
        F.count_if(F.col("lead_cents") < F.col("tail_cents")).alias("losses")))
    dim = b.supplier_dim(t).select(F.col("supp_key").alias("lead_key"), "supplier_name")
    value = b.money("_cents")
    return scored.join(dim, "lead_key").select(
        "supplier_name", "total_orders", value.alias("total_value"),
        (value / F.col("total_orders")).alias("avg_value"), "wins", "draws", "losses")


@query("order_results_by_priority", sql(f"""
    SELECT priority, 'ORDER:' || m.order_key AS order_id, order_date,
           l.supplier_name AS lead_supplier, t.supplier_name AS tail_supplier,
           CAST(lead_value AS DOUBLE) AS lead_value, CAST(tail_value AS DOUBLE) AS tail_value,
           {WINNER_SQL} AS winner
    FROM order_sides m JOIN order_dim o ON o.order_key = m.order_key
    JOIN supplier_dim l ON l.supp_key = lead_key JOIN supplier_dim t ON t.supp_key = tail_key
    WHERE YEAR(order_date) = 1998""", "order_sides", "order_dim", "supplier_dim"))
def order_results_by_priority(t: Tables, year: int = YEAR, priority: str | None = None) -> DataFrame:
    placed = b.order_dim(t).where(in_year("o_orderdate", year))
    if priority is not None:
        placed = placed.where(F.col("priority") == priority)
    placed = placed.select("order_key", "priority", "order_date")
    return named_sides(t, b.order_sides(t).join(placed, "order_key")).select(
        "priority", order_id().alias("order_id"), "order_date", "lead_supplier", "tail_supplier",
        b.money("lead_cents").alias("lead_value"),
        b.money("tail_cents").alias("tail_value"), winner().alias("winner"))


@query("part_trajectory", sql("""
    SELECT 'PART:' || e.part_key AS part_id, part_name, supplier_name, region, start_date, end_date,
           DATEDIFF('day', start_date, end_date) AS days, lines
    FROM supplied_by e JOIN part_dim p ON p.part_key = e.part_key
    JOIN supplier_dim s ON s.supp_key = e.supp_key""", "supplied_by", "part_dim", "supplier_dim"))
def part_trajectory(t: Tables, part: int | None = None) -> DataFrame:
    tenures = b.supplied_by(t)
    if part is not None:
        tenures = tenures.where(F.col("part_key") == part)
    return (tenures.join(b.part_dim(t), "part_key").join(b.supplier_dim(t), "supp_key")
            .select(part_id().alias("part_id"), "part_name", "supplier_name", "region",
                    "start_date", "end_date",
                    tenure_days(F.col("start_date"), F.col("end_date")).cast("bigint").alias("days"),
                    "lines"))


@query("head_to_head", sql(f"""
    SELECT LEAST(l.supplier_name, t.supplier_name) AS supplier_a,
           GREATEST(l.supplier_name, t.supplier_name) AS supplier_b,
           'ORDER:' || m.order_key AS order_id, order_date, l.supplier_name AS lead_supplier,
           t.supplier_name AS tail_supplier, CAST(lead_value AS DOUBLE) AS lead_value,
           CAST(tail_value AS DOUBLE) AS tail_value, priority, {WINNER_SQL} AS winner
    FROM matchups m JOIN order_dim o ON o.order_key = m.order_key
    JOIN supplier_dim l ON l.supp_key = lead_key JOIN supplier_dim t ON t.supp_key = tail_key""",
                           "matchups", "order_dim", "supplier_dim"))
def head_to_head(t: Tables, a: str | None = None, c: str | None = None) -> DataFrame:
    """Every order between two suppliers, both directions; all pairs when none is named."""
    placed = b.order_dim(t).select("order_key", "priority", "order_date")
    rows = named_sides(t, b.matchups(t).join(placed, "order_key")).select(
        F.least("lead_supplier", "tail_supplier").alias("supplier_a"),
        F.greatest("lead_supplier", "tail_supplier").alias("supplier_b"),
        order_id().alias("order_id"), "order_date", "lead_supplier", "tail_supplier",
        b.money("lead_cents").alias("lead_value"),
        b.money("tail_cents").alias("tail_value"), "priority",
        winner().alias("winner"))
    if a is not None and c is not None:
        low, high = sorted((a, c))
        rows = rows.where((F.col("supplier_a") == low) & (F.col("supplier_b") == high))
    return rows


@query("returned_parts_in_matchups", sql("""
    SELECT LEAST(lead_key, tail_key) AS supp_a, GREATEST(lead_key, tail_key) AS supp_b,
           'PART:' || i.part_key AS part_id, p.brand, p.part_type, COUNT(*) AS orders_with_returns,
           CAST(SUM(returned) AS BIGINT) AS returned_lines, n.supplier_nations
    FROM in_order i JOIN matchups m ON m.order_key = i.order_key
    JOIN part_dim p ON p.part_key = i.part_key
    JOIN (SELECT part_key, STRING_AGG(DISTINCT nation, ', ' ORDER BY nation) AS supplier_nations
          FROM supplied_by e JOIN supplier_dim s ON s.supp_key = e.supp_key GROUP BY part_key) n
      ON n.part_key = i.part_key
    WHERE returned > 0 GROUP BY ALL""", "in_order", "matchups", "part_dim", "supplied_by",
                                         "supplier_dim"))
def returned_parts_in_matchups(t: Tables) -> DataFrame:
    """Returned parts per supplier matchup. Returns are summed before the tenures join,
    so a long tenure list does not multiply them."""
    sides = b.matchups(t).select("order_key", F.least(*SIDES).alias("supp_a"),
                                 F.greatest(*SIDES).alias("supp_b"))
    returns = (b.in_order(t).where("returned > 0").join(sides, "order_key")
               .groupBy("supp_a", "supp_b", "part_key")
               .agg(F.count("*").alias("orders_with_returns"),
                    F.sum("returned").alias("returned_lines")))
    return (returns.join(part_nations(t), "part_key").join(b.part_dim(t), "part_key")
            .select("supp_a", "supp_b", part_id().alias("part_id"), "brand", "part_type",
                    "orders_with_returns", "returned_lines", "supplier_nations"))


def part_nations(t: Tables) -> DataFrame:
    places = b.supplier_dim(t).select("supp_key", "nation")
    return (b.supplied_by(t).select("part_key", "supp_key").join(places, "supp_key")
            .groupBy("part_key").agg(bounded_list("nation").alias("supplier_nations")))


@query("co_supplied_with", sql("""
    SELECT 'PART:' || a.part_key AS part_id, 'SUPPLIER:' || a.supp_key AS supplier_id,
           a.start_date, a.end_date, ANY_VALUE(n.n) - 1 AS peers,
           COUNT(x.part_key) AS overlapping_peers
    FROM supplied_by a JOIN (SELECT supp_key, COUNT(*) n FROM supplied_by GROUP BY supp_key) n
      ON n.supp_key = a.supp_key
    LEFT JOIN supplied_by x ON x.supp_key = a.supp_key AND x.part_key <> a.part_key
      AND x.start_date <= COALESCE(a.end_date, DATE '9999-12-31')
      AND COALESCE(x.end_date, DATE '9999-12-31') >= a.start_date
    GROUP BY a.part_key, a.supp_key, a.start_date, a.end_date""", "supplied_by"))
def co_supplied_with(t: Tables) -> DataFrame:
    """For every tenure: parts sharing the supplier, and those sharing it at the same time."""
    return moves.peer_counts(b.supplied_by(t), "supp_key").select(
        part_id().alias("part_id"), supplier_id().alias("supplier_id"), "start_date", "end_date",
        "peers", "overlapping_peers")


@query("co_supplied_parts", sql("""
    SELECT 'PART:' || x.part_key AS part_id, 'SUPPLIER:' || x.supp_key AS supplier_id, x.start_date, x.end_date,
           CASE WHEN x.end_date IS NULL AND a.end_date IS NULL THEN NULL
                ELSE GREATEST(DATEDIFF('day', GREATEST(x.start_date, a.start_date), LEAST(
                     COALESCE(x.end_date, DATE '9999-12-31'), COALESCE(a.end_date, DATE '9999-12-31'))), 0) END AS overlap_days
    FROM supplied_by a JOIN supplied_by x ON x.supp_key = a.supp_key AND x.part_key <> a.part_key
    WHERE a.part_key = 1""", "supplied_by"))
def co_supplied_parts(t: Tables, part: int = 1) -> DataFrame:
    """The parts that ever shared a supplier with one part, with the true overlap in days."""
    rows = moves.peers_of(b.supplied_by(t).select("part_key", "supp_key", "start_date", "end_date"),
                          "supp_key", "part_key", part)
    far = F.to_date(F.lit("9999-12-31"))
    first = F.greatest("start_date", "own_start")
    last = F.least(F.coalesce("end_date", far), F.coalesce("own_end", far))
    return rows.select(
        part_id().alias("part_id"), supplier_id().alias("supplier_id"), "start_date", "end_date",
        F.when(last == far, F.lit(None)).when(last >= first, F.datediff(last, first))
        .otherwise(0).cast("bigint").alias("overlap_days"))


CONSECUTIVE_SQL = """
    SELECT *, LAG({m}) OVER w AS prev_member, LAG(end_date) OVER w AS prev_end,
           ROW_NUMBER() OVER w AS move_rank
    FROM {src} WINDOW w AS (PARTITION BY {e} ORDER BY start_date, {m})"""
PART_RANKED = {"ranked": CONSECUTIVE_SQL.format(src="supplied_by", e="part_key", m="supp_key")}


def part_moves(t: Tables) -> DataFrame:
    tenures = b.supplied_by(t).select("part_key", "supp_key", "start_date", "end_date")
    return moves.consecutive_moves(tenures, ["part_key"], "supp_key", t.rows("lineitem"))


@query("direct_moves", sql("""
    SELECT 'PART:' || part_key AS part_id, 'SUPPLIER:' || prev_member AS from_supplier,
           'SUPPLIER:' || supp_key AS to_supplier, prev_end AS left_date, start_date AS joined_date
    FROM ranked WHERE prev_end < start_date""", "supplied_by", extra=PART_RANKED))
def direct_moves(t: Tables) -> DataFrame:
    """Consecutive tenures only; all pairs at two named suppliers are in moves_between_suppliers."""
    return part_moves(t).select(
        part_id().alias("part_id"), supplier_id("from_member").alias("from_supplier"),
        supplier_id("to_member").alias("to_supplier"), "left_date", "joined_date")


@query("moves_between_suppliers", sql("""
    SELECT 'PART:' || x.part_key AS part_id, 'SUPPLIER:' || x.supp_key AS from_supplier,
           'SUPPLIER:' || y.supp_key AS to_supplier, x.end_date AS left_date, y.start_date AS joined_date
    FROM supplied_by x JOIN supplied_by y ON y.part_key = x.part_key AND y.supp_key <> x.supp_key
    WHERE x.supp_key IN (1, 2) AND y.supp_key IN (1, 2)""", "supplied_by"))
def moves_between_suppliers(t: Tables, a: int = 1, c: int = 2, in_time_order: bool = False) -> DataFrame:
    """Every pair of tenures of one part at two named suppliers, in both directions."""
    tenures = b.supplied_by(t).select("part_key", "supp_key", "start_date", "end_date")
    return moves.moves_between(tenures, ["part_key"], "supp_key", a, c, in_time_order).select(
        part_id().alias("part_id"), supplier_id(F.col("from_member").cast("bigint")).alias("from_supplier"),
        supplier_id(F.col("to_member").cast("bigint")).alias("to_supplier"), "left_date", "joined_date")


def part_places(t: Tables) -> DataFrame:
    """Part tenures with the supplier's nation key."""
    places = t.supplier.select(F.col("s_suppkey").alias("supp_key"), F.col("s_nationkey").alias("nation_key"))
    return b.supplied_by(t).select("part_key", "supp_key", "start_date", "end_date").join(
        places, "supp_key")


@query("moves_between_nations", sql("""
    SELECT a.nation AS from_nation, c.nation AS to_nation, COUNT(*) AS move_count,
           COUNT(DISTINCT a.part_key) AS parts_moved, a.nation || ' to ' || c.nation AS direction
    FROM (SELECT e.*, nation FROM supplied_by e JOIN supplier_dim s ON s.supp_key = e.supp_key) a
    JOIN (SELECT e.*, nation FROM supplied_by e JOIN supplier_dim s ON s.supp_key = e.supp_key) c
      ON a.part_key = c.part_key AND a.supp_key <> c.supp_key AND c.start_date > a.end_date
    WHERE a.nation <> c.nation GROUP BY a.nation, c.nation""", "supplied_by", "supplier_dim"))
def moves_between_nations(t: Tables) -> DataFrame:
    nations = [r[0] for r in t.nation.select("n_nationkey").where("n_nationkey IS NOT NULL").distinct().collect()]
    counts = moves.later_pair_counts(part_places(t), ["part_key"], "nation_key", sorted(nations), t.lineitem.count())
    names = lambda key, name: t.nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name))
    return (counts.join(names("from_place", "from_nation"), "from_place")
            .join(names("to_place", "to_nation"), "to_place").select(
        "from_nation", "to_nation", "move_count", F.col("entities_moved").alias("parts_moved"),
        F.concat_ws(" to ", "from_nation", "to_nation").alias("direction")))


@query("part_performance", sql(f"""
    SELECT 'PART:' || i.part_key AS part_id, part_name, brand, part_type, COUNT(*) AS orders,
           CAST(SUM(returned) AS BIGINT) AS returned_lines,
           CAST(SUM(accepted) AS BIGINT) AS accepted_lines,
           CAST(SUM(returned) AS DOUBLE) / COUNT(*) AS avg_returned,
           {ratio2('SUM(returned)', 'COUNT(*)')} AS returned_per_order
    FROM in_order i JOIN order_dim o ON o.order_key = i.order_key
    JOIN part_dim p ON p.part_key = i.part_key WHERE order_date >= DATE '1998-01-01'
    GROUP BY i.part_key, part_name, brand, part_type HAVING SUM(returned) > 0""",
                               "in_order", "order_dim", "part_dim"))
def part_performance(t: Tables, since: dt.datetime = PERFORMANCE_SINCE) -> DataFrame:
    recent = t.orders.where(F.col("o_orderdate") >= F.lit(since).cast("timestamp_ntz")).select(
        F.col("o_orderkey").alias("order_key"))
    totals = (b.in_order(t).join(recent, "order_key").groupBy("part_key")
              .agg(F.count("*").alias("orders"), F.sum("returned").alias("returned_lines"),
                   F.sum("accepted").alias("accepted_lines")).where("returned_lines > 0"))
    return totals.join(b.part_dim(t), "part_key").select(
        part_id().alias("part_id"), "part_name", "brand", "part_type", "orders", "returned_lines",
        "accepted_lines",
        (F.col("returned_lines").cast("double") / F.col("orders")).alias("avg_returned"),
        round_ratio(F.col("returned_lines"), F.col("orders")).alias("returned_per_order"))


@query("supplier_activity", sql("""
    SELECT supplier_name, region,
           COUNT(*) FILTER (start_date >= DATE '2000-01-01') AS parts_in,
           COUNT(*) FILTER (end_date >= DATE '2000-01-01') AS parts_out,
           COUNT(*) FILTER (start_date >= DATE '2000-01-01')
             - COUNT(*) FILTER (end_date >= DATE '2000-01-01') AS net_moves
    FROM supplier_dim s LEFT JOIN supplied_by e ON e.supp_key = s.supp_key
    GROUP BY s.supp_key, supplier_name, region HAVING parts_in > 0 OR parts_out > 0""",
                                "supplied_by", "supplier_dim"))
def supplier_activity(t: Tables, since: dt.date = SINCE) -> DataFrame:
    """A tenure is unique per (part, supplier), so conditional counts in one pass replace
    the double join with distinct counts."""
    day = F.lit(since)
    counts = b.supplied_by(t).groupBy("supp_key").agg(
        F.count_if(F.col("start_date") >= day).alias("parts_in"),
        F.count_if(F.col("end_date") >= day).alias("parts_out"))
    return (counts.where("parts_in > 0 OR parts_out > 0").join(b.supplier_dim(t), "supp_key")
            .select("supplier_name", "region", "parts_in", "parts_out",
                    (F.col("parts_in") - F.col("parts_out")).alias("net_moves")))


@query("customer_succession", sql("""
    SELECT 'SUPPLIER:' || a.supp_key AS supplier_id, 'CUSTOMER:' || a.cust_key AS previous_customer,
           'CUSTOMER:' || (SELECT MIN(x.cust_key) FROM buys_from x
                           WHERE x.supp_key = a.supp_key AND x.start_date = n.next_start)
             AS next_customer,
           a.end_date AS transition_date, n.next_start,
           DATEDIFF('day', a.end_date, n.next_start) AS days_between, n.later AS later_tenures,
           'CUSTOMER:' || l.cust_key AS later_customer, l.start_date AS later_start,
           DATEDIFF('day', a.end_date, l.start_date) AS days_to_later
    FROM buys_from a JOIN (
      SELECT e.supp_key, e.end_date, MIN(c.start_date) AS next_start, CAST(SUM(c.n) AS BIGINT) AS later
      FROM (SELECT DISTINCT supp_key, end_date FROM buys_from WHERE end_date IS NOT NULL) e
      JOIN (SELECT supp_key, start_date, COUNT(*) n FROM buys_from GROUP BY 1, 2) c
        ON c.supp_key = e.supp_key AND c.start_date > e.end_date GROUP BY 1, 2) n
      ON n.supp_key = a.supp_key AND n.end_date = a.end_date
    JOIN buys_from l ON l.supp_key = a.supp_key AND l.start_date > a.end_date""", "buys_from"))
def customer_succession(t: Tables) -> DataFrame:
    """Every engagement that began after each ended one, one row per pair, with who took over next and how many came later."""
    rows = t.rows("lineitem")
    tenures = cut_lineage(b.buys_from(t).select("cust_key", "supp_key", "start_date", "end_date"))  # read from four sides
    ended = cut_lineage(moves.successors(tenures, "supp_key", "cust_key", rows))
    # ids are made after rows were moved and before they become pairs, which are many
    pairs = moves.later_members(ended.drop("start_date"), tenures, "supp_key", "cust_key", rows, ended_as={
        "supplier_id": supplier_id(), "previous_customer": typed_id("CUSTOMER", "cust_key"), "next_customer": typed_id("CUSTOMER", "next_member"),
        "days_between": F.datediff("next_start", "end_date").cast("bigint")}, later_as={"later_customer": typed_id("CUSTOMER", "later_member")})
    return pairs.select(
        "supplier_id", "previous_customer", "next_customer", F.col("end_date").alias("transition_date"), "next_start",
        "days_between", "later_tenures", "later_customer", "later_start",
        F.datediff("later_start", "end_date").cast("bigint").alias("days_to_later"))


@query("move_chain", sql(f"""
    SELECT 'PART:' || part_key AS part_id, CAST(move_rank AS INT) AS move_rank,
           'SUPPLIER:' || r.supp_key AS supplier_id, region, start_date, end_date,
           CAST(value AS DOUBLE) AS value,
           DATEDIFF('day', start_date, COALESCE(end_date, {AS_OF})) AS days,
           CASE WHEN prev_member IS NULL THEN 'SUPPLIER:' || r.supp_key
                ELSE 'SUPPLIER:' || prev_member || ' → ' || 'SUPPLIER:' || r.supp_key END AS step
    FROM ranked r JOIN supplier_dim s ON s.supp_key = r.supp_key""", "supplied_by", "supplier_dim",
                         extra=PART_RANKED))
def move_chain(t: Tables, as_of=b.AS_OF) -> DataFrame:
    """Chronological chain of every part, one step per row (see ``move_path`` for one part)."""
    tenures = cut_lineage(b.supplied_by(t).drop("lines"))  # ranked from two sides
    ranked = moves.ranked_tenures(tenures, ["part_key"], "supp_key", t.rows("lineitem"))
    places = b.supplier_dim(t).select("supp_key", "region")
    return ranked.join(places, "supp_key").select(
        part_id().alias("part_id"), "move_rank", supplier_id().alias("supplier_id"), "region",
        "start_date", "end_date", b.money("cents").alias("value"),
        tenure_days(F.col("start_date"), F.col("end_date"), as_of).cast("bigint").alias("days"),
        F.concat_ws(" → ", supplier_id("prev_member"), supplier_id()).alias("step"))


def move_path(t: Tables, part: int) -> DataFrame:
    """One named part's chain with the path travelled so far on every row."""
    one = b.supplied_by(t).where(F.col("part_key") == part)
    ranked = moves.ranked_tenures(one, ["part_key"], "supp_key")
    steps = F.array_sort(F.collect_list(F.struct("move_rank", supplier_id().alias("supplier_id"))))
    whole = ranked.groupBy("part_key").agg(steps.alias("steps"))
    return ranked.join(whole, "part_key").select(
        part_id().alias("part_id"), "move_rank", supplier_id().alias("supplier_id"),
        "start_date", "end_date",
        F.array_join(F.transform(F.slice("steps", 1, F.col("move_rank")),
                                 lambda s: s["supplier_id"]), " → ").alias("path"))


@query("parts_of_brand", """
    SELECT p_name AS part_name, 'PART:' || p_partkey AS part_id, p_type AS part_type,
           p_size AS part_size FROM part WHERE p_brand = 'Brand#2'""")
def parts_of_brand(t: Tables, brand: str = "Brand#2") -> DataFrame:
    return b.part_dim(t).where(F.col("brand") == brand).select(
        "part_name", part_id().alias("part_id"), "part_type", "part_size")


@query("active_edge_counts", sql(f"""
    SELECT edge_type, COUNT(*) AS active_edges FROM edges
    WHERE effective_end IS NULL OR effective_end >= {AS_OF} GROUP BY edge_type""", "edges"))
def active_edge_counts(t: Tables) -> DataFrame:
    return (b.kg_edges(t).where(active_as_of(b.AS_OF, end="effective_end"))
            .groupBy("edge_type").agg(F.count("*").alias("active_edges")))


@query("current_tenures", sql(f"""
    SELECT part_name, supplier_name, 'PART:' || p.part_key AS part_id,
           'SUPPLIER:' || s.supp_key AS supplier_id, start_date, end_date
    FROM supplied_by e JOIN part_dim p ON p.part_key = e.part_key
    JOIN supplier_dim s ON s.supp_key = e.supp_key WHERE {active()}""",
                              "supplied_by", "part_dim", "supplier_dim"))
def current_tenures(t: Tables) -> DataFrame:
    return (b.supplied_by(t).where(active_as_of(b.AS_OF)).join(b.part_dim(t), "part_key")
            .join(b.supplier_dim(t), "supp_key")
            .select("part_name", "supplier_name", part_id().alias("part_id"),
                    supplier_id().alias("supplier_id"), "start_date", "end_date"))


@query("part_profile", sql("""
    SELECT 'PART:' || p.part_key AS part_id, part_name, brand, part_type,
           COALESCE(c.suppliers, 0) AS suppliers, c.supplier_nations, c.first_start, c.last_end,
           COALESCE(q.returned_lines, 0) AS returned_lines,
           COALESCE(q.accepted_lines, 0) AS accepted_lines, COALESCE(q.orders, 0) AS orders,
           COALESCE(CAST(q.quantity AS DOUBLE) / q.orders, 0) AS avg_quantity
    FROM part_dim p LEFT JOIN (
      SELECT part_key, COUNT(*) AS suppliers, MIN(start_date) AS first_start,
             MAX(end_date) AS last_end,
             STRING_AGG(DISTINCT nation, ', ' ORDER BY nation) AS supplier_nations
      FROM supplied_by e JOIN supplier_dim s ON s.supp_key = e.supp_key GROUP BY part_key) c
      ON c.part_key = p.part_key
    LEFT JOIN (
      SELECT part_key, CAST(SUM(returned) AS BIGINT) AS returned_lines,
             CAST(SUM(accepted) AS BIGINT) AS accepted_lines, COUNT(*) AS orders,
             SUM(quantity) AS quantity FROM in_order GROUP BY part_key) q
      ON q.part_key = p.part_key""", "part_dim", "supplied_by", "supplier_dim", "in_order"))
def part_profile(t: Tables) -> DataFrame:
    career = (b.supplied_by(t).join(b.supplier_dim(t), "supp_key").groupBy("part_key").agg(
        F.count("*").alias("suppliers"), bounded_list("nation").alias("supplier_nations"),
        F.min("start_date").alias("first_start"), F.max("end_date").alias("last_end")))
    stats = b.in_order(t).groupBy("part_key").agg(
        F.sum("returned").alias("returned_lines"), F.sum("accepted").alias("accepted_lines"),
        F.count("*").alias("orders"), F.sum("quantity").alias("quantity"))
    zero = F.lit(0).cast("bigint")
    return (b.part_dim(t).join(career, "part_key", "left").join(stats, "part_key", "left").select(
        part_id().alias("part_id"), "part_name", "brand", "part_type",
        F.coalesce("suppliers", zero).alias("suppliers"), "supplier_nations", "first_start",
        "last_end", F.coalesce("returned_lines", zero).alias("returned_lines"),
        F.coalesce("accepted_lines", zero).alias("accepted_lines"),
        F.coalesce("orders", zero).alias("orders"),
        F.coalesce(F.col("quantity").cast("double") / F.col("orders"), F.lit(0.0)).alias("avg_quantity")))


@query("co_supplied_overlap", sql("""
    SELECT 'PART:' || a.part_key AS part1, 'PART:' || c.part_key AS part2,
           COUNT(*) AS suppliers_together,
           STRING_AGG(DISTINCT s.nation, ', ' ORDER BY s.nation) AS shared_nations,
           MIN(GREATEST(a.start_date, c.start_date)) AS first_date,
           NULLIF(MAX(LEAST(COALESCE(a.end_date, DATE '9999-12-31'),
                            COALESCE(c.end_date, DATE '9999-12-31'))), DATE '9999-12-31') AS last_date
    FROM supplied_by a JOIN supplied_by c ON a.supp_key = c.supp_key AND a.part_key < c.part_key
      AND a.start_date <= COALESCE(c.end_date, DATE '9999-12-31')
      AND c.start_date <= COALESCE(a.end_date, DATE '9999-12-31')
    JOIN supplier_dim s ON s.supp_key = a.supp_key
    GROUP BY a.part_key, c.part_key""", "supplied_by", "supplier_dim"))
def co_supplied_overlap(t: Tables) -> DataFrame:
    """Pairs of parts delivered by the same supplier at the same time."""
    tenures = b.supplied_by(t).select("part_key", "supp_key", "start_date", "end_date")
    pairs = moves.same_place_pairs(tenures, "supp_key", "part_key")
    places = b.supplier_dim(t).select("supp_key", "nation")
    still = F.max(F.col("overlap_end").isNull().cast("int")) == 1
    return (pairs.join(places, "supp_key").groupBy("member1", "member2").agg(
        F.count("*").alias("suppliers_together"), bounded_list("nation").alias("shared_nations"),
        F.min("overlap_start").alias("first_date"),
        F.when(~still, F.max("overlap_end")).alias("last_date"))
        .select(part_id("member1").alias("part1"), part_id("member2").alias("part2"),
                "suppliers_together", "shared_nations", "first_date", "last_date"))


@query("mutual_moves", sql("""
    SELECT 'SUPPLIER:' || x.f AS supplier1, 'SUPPLIER:' || x.t AS supplier2, x.n AS moves_1_to_2,
           COALESCE(y.n, 0) AS moves_2_to_1, x.n + COALESCE(y.n, 0) AS total_exchanges
    FROM m x LEFT JOIN m y ON y.f = x.t AND y.t = x.f""", "supplied_by", extra={
        **PART_RANKED, "m": """SELECT prev_member AS f, supp_key AS t, COUNT(*) AS n FROM ranked
                               WHERE prev_end < start_date GROUP BY 1, 2"""}))
def mutual_moves(t: Tables) -> DataFrame:
    """Moves between every two suppliers and back. Both directions are counted under the
    unordered pair in one aggregation, so no second join of the counts is needed."""
    f, to = F.col("from_member"), F.col("to_member")
    pairs = part_moves(t).groupBy(F.least(f, to).alias("low"), F.greatest(f, to).alias("high")).agg(
        F.count_if(f < to).alias("up"), F.count_if(f > to).alias("down"))
    rows = pairs.select(F.explode(F.array(
        F.struct(F.col("low").alias("a"), F.col("high").alias("z"), F.col("up").alias("out"),
                 F.col("down").alias("back")),
        F.struct(F.col("high").alias("a"), F.col("low").alias("z"), F.col("down").alias("out"),
                 F.col("up").alias("back")))).alias("r")).select("r.*").where("out > 0")
    return rows.select(supplier_id("a").alias("supplier1"), supplier_id("z").alias("supplier2"),
                       F.col("out").alias("moves_1_to_2"), F.col("back").alias("moves_2_to_1"),
                       (F.col("out") + F.col("back")).alias("total_exchanges"))
