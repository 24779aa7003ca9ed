"""Shared CTEs of the SQL checks: the same relations in plain SQL over the given tables."""

from __future__ import annotations

AS_OF = "DATE '2001-01-01'"
OPEN_FROM = "DATE '2001-06-01'"

# name -> (names it builds on, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "supplied_by": ((), f"""
        SELECT l_partkey AS part_key, l_suppkey AS supp_key,
               CAST(MIN(l_shipdate) AS DATE) AS start_date,
               CASE WHEN CAST(MAX(l_shipdate) AS DATE) < {OPEN_FROM}
                    THEN CAST(MAX(l_shipdate) AS DATE) END AS end_date,
               SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS value, COUNT(*) AS lines
        FROM lineitem GROUP BY l_partkey, l_suppkey"""),
    "buys_from": ((), f"""
        SELECT o_custkey AS cust_key, l_suppkey AS supp_key,
               CAST(MIN(o_orderdate) AS DATE) AS start_date,
               CASE WHEN CAST(MAX(o_orderdate) AS DATE) < {OPEN_FROM}
                    THEN CAST(MAX(o_orderdate) AS DATE) END AS end_date,
               SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS value, COUNT(*) AS lines
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey"""),
    "in_order": ((), """
        SELECT l_partkey AS part_key, l_orderkey AS order_key,
               CAST(FLOOR(SUM(ROUND(l_quantity * 100)) / 100) AS BIGINT) AS quantity,
               COUNT(*) FILTER (l_returnflag = 'R') AS returned,
               COUNT(*) FILTER (l_returnflag = 'A') AS accepted,
               COUNT(*) FILTER (l_returnflag = 'N') AS not_returned
        FROM lineitem GROUP BY l_partkey, l_orderkey"""),
    "order_dim": ((), """
        SELECT o_orderkey AS order_key, o_custkey AS cust_key,
               CAST(o_orderdate AS DATE) AS order_date, o_orderpriority AS priority,
               o_orderstatus AS status FROM orders"""),
    "lead_tail": ((), """
        SELECT l_orderkey AS order_key,
               FIRST(l_suppkey ORDER BY l_linenumber, l_suppkey) AS lead_key,
               FIRST(l_suppkey ORDER BY l_linenumber DESC, l_suppkey DESC) AS tail_key
        FROM lineitem GROUP BY l_orderkey"""),
    "order_supplier": ((), """
        SELECT l_orderkey AS order_key, l_suppkey AS supp_key,
               SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS value
        FROM lineitem GROUP BY l_orderkey, l_suppkey"""),
    "order_sides": (("lead_tail", "order_supplier"), """
        SELECT lt.order_key, lead_key, tail_key, a.value AS lead_value, b.value AS tail_value
        FROM lead_tail lt
        JOIN order_supplier a ON a.order_key = lt.order_key AND a.supp_key = lead_key
        JOIN order_supplier b ON b.order_key = lt.order_key AND b.supp_key = tail_key"""),
    "matchups": (("order_sides",), "SELECT * FROM order_sides WHERE lead_key <> tail_key"),
    "supplier_dim": ((), """
        SELECT s_suppkey AS supp_key, s_name AS supplier_name, n_name AS nation, r_name AS region
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey"""),
    "customer_dim": ((), """
        SELECT c_custkey AS cust_key, c_name AS customer_name, n_name AS origin,
               r_name AS home_region, c_mktsegment AS segment
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey"""),
    "part_dim": ((), """
        SELECT p_partkey AS part_key, p_name AS part_name, p_brand AS brand, p_type AS part_type,
               p_size AS part_size, p_retailprice AS retail_price FROM part"""),
    "engaged": (("supplied_by", "buys_from"), """
        SELECT 'Part' AS role, part_key AS party_key, supp_key, 'SUPPLIED_BY' AS via_rel,
               start_date, end_date, value FROM supplied_by
        UNION ALL
        SELECT 'Customer', cust_key, supp_key, 'BUYS_FROM', start_date, end_date, value
        FROM buys_from"""),
    "party_dim": (("customer_dim",), """
        SELECT 'Part' AS role, p_partkey AS party_key, p_name AS party_name, p_brand AS origin,
               CAST(NULL AS VARCHAR) AS home_region FROM part
        UNION ALL
        SELECT 'Customer', cust_key, customer_name, origin, home_region FROM customer_dim"""),
    "pe": (("engaged", "party_dim", "supplier_dim"), """
        SELECT e.*, UPPER(e.role) || ':' || e.party_key AS party_id, party_name, origin,
               home_region, supplier_name, nation, region
        FROM engaged e JOIN party_dim p ON p.role = e.role AND p.party_key = e.party_key
        JOIN supplier_dim s ON s.supp_key = e.supp_key"""),
    "node_keys": ((), """
        SELECT 'PART:' || p_partkey AS node_id, 'PART' AS node_type FROM part
        UNION ALL SELECT 'CUSTOMER:' || c_custkey, 'CUSTOMER' FROM customer
        UNION ALL SELECT 'SUPPLIER:' || s_suppkey, 'SUPPLIER' FROM supplier
        UNION ALL SELECT 'ORDER:' || o_orderkey, 'ORDER' FROM orders
        UNION ALL SELECT 'NATION:' || n_nationkey, 'NATION' FROM nation
        UNION ALL SELECT 'REGION:' || r_regionkey, 'REGION' FROM region"""),
    "edges": (("supplied_by", "buys_from", "in_order", "order_dim", "lead_tail"), """
        SELECT 'SUPPLIED_BY' AS edge_type, 'PART:' || part_key AS src_id,
               'SUPPLIER:' || supp_key AS dst_id, start_date AS effective_start,
               end_date AS effective_end FROM supplied_by
        UNION ALL SELECT 'BUYS_FROM', 'CUSTOMER:' || cust_key, 'SUPPLIER:' || supp_key,
               start_date, end_date FROM buys_from
        UNION ALL SELECT 'IN_ORDER', 'PART:' || part_key, 'ORDER:' || i.order_key,
               order_date, order_date FROM in_order i JOIN order_dim o ON o.order_key = i.order_key
        UNION ALL SELECT 'LEAD_SUPPLIER', 'SUPPLIER:' || lead_key, 'ORDER:' || l.order_key,
               order_date, NULL FROM lead_tail l JOIN order_dim o ON o.order_key = l.order_key
        UNION ALL SELECT 'TAIL_SUPPLIER', 'SUPPLIER:' || tail_key, 'ORDER:' || l.order_key,
               order_date, NULL FROM lead_tail l JOIN order_dim o ON o.order_key = l.order_key
        UNION ALL SELECT 'WITHIN', 'CUSTOMER:' || c_custkey, 'NATION:' || c_nationkey, NULL, NULL
               FROM customer
        UNION ALL SELECT 'WITHIN', 'SUPPLIER:' || s_suppkey, 'NATION:' || s_nationkey, NULL, NULL
               FROM supplier
        UNION ALL SELECT 'WITHIN', 'NATION:' || n_nationkey, 'REGION:' || n_regionkey, NULL, NULL
               FROM nation"""),
}


def sql(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Put the named CTEs, and what they build on, before ``body``."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order]
    # evaluated once each: search levels are read several times
    parts += [f"{n} AS MATERIALIZED ({b})" for n, b in (extra or {}).items()]
    return (f"WITH {', '.join(parts)} {body}") if parts else body


def active(prefix: str = "") -> str:
    return f"({prefix}end_date IS NULL OR {prefix}end_date >= {AS_OF})"


def ratio2(num: str, den: str) -> str:
    """num/den rounded half up to 2 digits, in whole numbers."""
    return (f"CAST((CAST({num} AS BIGINT) * 200 + CAST({den} AS BIGINT)) // "
            f"(CAST({den} AS BIGINT) * 2) AS DOUBLE) / 100")
