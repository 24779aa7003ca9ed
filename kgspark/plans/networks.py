"""Graph analytics on the part graph (hubs: orders, suppliers) and the supplier graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kgspark.functions.ids import typed_id
from kgspark.operators.graph import centrality, community, temporal, traverse
from kgspark.operators.graph.build import (Graph, canonical_pairs, first_relation_wins, hub_sizes,
                                           memberships)
from kgspark.plans import binding as b
from kgspark.plans.checks import sql
from kgspark.plans.concrete import PART_RANKED, part_id, part_moves, supplier_id
from kgspark.plans.registry import query
from kgspark.session import cut_lineage
from kgspark.sources.tables import Tables

START_PART, END_PART, START_SUPPLIER = 1, 2, 1
MAX_SUPPLIER_DEGREES, MAX_PART_HOPS = 3, 5


# --- graphs ----------------------------------------------------------------------------------

def part_members(t: Tables, relations=("supplier", "order")) -> DataFrame:
    frames = []
    if "supplier" in relations:
        frames.append(memberships(t.lineitem, "l_partkey", "l_suppkey", "supplier"))
    if "order" in relations:
        frames.append(memberships(t.lineitem, "l_partkey", "l_orderkey", "order"))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def supplier_matches(t: Tables) -> DataFrame:
    met = b.order_sides(t, b.line_rows(t)).where("lead_key <> tail_key")
    return canonical_pairs(met, "lead_key", "tail_key", "order_key", "match")


def supplier_pairs(t: Tables) -> DataFrame:
    """Supplier pairs that met on an order or passed a part on; a match outranks a move. Matches are written first,
    so that the shuffles of the lines behind them are gone before those of the moves are made."""
    matched = cut_lineage(supplier_matches(t))
    moved = canonical_pairs(part_moves(t), "from_member", "to_member", "part_key", "move")
    return first_relation_wins([matched, moved])


def load_graph(t: Tables, graph_type: str, relations=None) -> Graph:
    """The 'part' graph (hubs) or the 'supplier' graph (pair edges); anything else is an error."""
    if graph_type == "part":
        nodes = t.part.select(F.col("p_partkey").alias("id"))
        return Graph(nodes, members=part_members(t, relations or ("supplier", "order")))
    if graph_type == "supplier":
        nodes = t.supplier.select(F.col("s_suppkey").alias("id"))
        pairs = {("match",): supplier_matches, ("match", "move"): supplier_pairs}[relations or ("match", "move")](t)
        return Graph(nodes, pairs=cut_lineage(pairs.select("a", "b")))
    raise ValueError(f"unknown graph type {graph_type}")


@query("graph_nodes_part", """SELECT 'PART:' || p_partkey AS id, p_name AS name, p_type AS part_type,
    p_brand AS brand FROM part""")
def graph_nodes_part(t: Tables) -> DataFrame:
    return b.part_dim(t).select(part_id().alias("id"), F.col("part_name").alias("name"), "part_type", "brand")


@query("graph_edges_shared_supplier", """
    SELECT 'SUPPLIER:' || l_suppkey AS hub_id, 'supplier' AS relationship,
           COUNT(DISTINCT l_partkey) AS members,
           CAST(COUNT(DISTINCT l_partkey) * (COUNT(DISTINCT l_partkey) - 1) // 2 AS BIGINT) AS pairs
    FROM lineitem GROUP BY l_suppkey""")
def graph_edges_shared_supplier(t: Tables) -> DataFrame:
    """Parts sharing a supplier, as one hub per supplier with the pairs it stands for."""
    return hub_sizes(part_members(t, ("supplier",))).select(
        supplier_id("hub").alias("hub_id"), F.col("kind").alias("relationship"), "members", "pairs")


@query("graph_edges_co_order", """
    SELECT 'ORDER:' || l_orderkey AS hub_id, 'order' AS relationship,
           COUNT(DISTINCT l_partkey) AS members,
           CAST(COUNT(DISTINCT l_partkey) * (COUNT(DISTINCT l_partkey) - 1) // 2 AS BIGINT) AS pairs
    FROM lineitem GROUP BY l_orderkey""")
def graph_edges_co_order(t: Tables) -> DataFrame:
    """Parts on the same order, as one hub per order with the pairs it stands for."""
    return hub_sizes(part_members(t, ("order",))).select(
        typed_id("ORDER", "hub").alias("hub_id"), F.col("kind").alias("relationship"), "members", "pairs")


MATCH_SQL = """SELECT LEAST(lead_key, tail_key) AS a, GREATEST(lead_key, tail_key) AS b,
    MIN(order_key) AS via, COUNT(*) AS links FROM matchups GROUP BY 1, 2"""


@query("graph_edges_supplier", sql("""
    SELECT 'SUPPLIER:' || COALESCE(m.a, v.a) AS src_id, 'SUPPLIER:' || COALESCE(m.b, v.b) AS dst_id,
           CASE WHEN m.a IS NOT NULL THEN 'match' ELSE 'move' END AS relationship,
           COALESCE(m.via, v.via) AS via_key,
           CAST(COALESCE(m.links, 0) + COALESCE(v.links, 0) AS BIGINT) AS links
    FROM m FULL JOIN v ON v.a = m.a AND v.b = m.b""", "matchups", "supplied_by", extra={
        **PART_RANKED, "m": MATCH_SQL,
        "v": """SELECT LEAST(prev_member, supp_key) AS a, GREATEST(prev_member, supp_key) AS b,
                MIN(part_key) AS via, COUNT(*) AS links FROM ranked WHERE prev_end < start_date GROUP BY 1, 2"""}))
def graph_edges_supplier(t: Tables) -> DataFrame:
    return supplier_pairs(t).select(
        supplier_id("a").alias("src_id"), supplier_id("b").alias("dst_id"), "relationship",
        F.col("via").alias("via_key"), "links")


# --- SQL pieces: unrolled search levels --------------------------------------------------------

PART_HUBS = """SELECT DISTINCT l_partkey AS node, 'order' AS kind, l_orderkey AS hub FROM lineitem
    UNION ALL SELECT DISTINCT l_partkey, 'supplier', l_suppkey FROM lineitem"""
CO_SUPPLIER_ADJ = """SELECT x.l_partkey AS a, y.l_partkey AS b, MIN(x.l_suppkey) AS via
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) x
    JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) y
      ON y.l_suppkey = x.l_suppkey AND y.l_partkey <> x.l_partkey GROUP BY 1, 2"""
CO_PART_ADJ = """SELECT x.l_suppkey AS a, y.l_suppkey AS b, MIN(x.l_partkey) AS via
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) x
    JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) y
      ON y.l_partkey = x.l_partkey AND y.l_suppkey <> x.l_suppkey GROUP BY 1, 2"""
SUPPLIER_ADJ = """SELECT lead_key AS a, tail_key AS b FROM matchups UNION SELECT tail_key, lead_key FROM matchups
    UNION SELECT prev_member, supp_key FROM ranked WHERE prev_end < start_date AND prev_member <> supp_key
    UNION SELECT supp_key, prev_member FROM ranked WHERE prev_end < start_date AND prev_member <> supp_key"""


def level_ctes(adj: str, sources: str, depth: int) -> dict[str, str]:
    """l0..l<depth>: (source, node, parent) per search level, smallest parent first; r: all."""
    ctes = {"adj": adj, "l0": f"SELECT source, source AS node, CAST(NULL AS BIGINT) AS parent FROM ({sources})"}
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT source, node FROM l{i}" for i in range(max(0, d - 2), d))
        ctes[f"l{d}"] = f"""SELECT f.source, adj.b AS node, MIN(f.node) AS parent FROM l{d - 1} f
            JOIN adj ON adj.a = f.node ANTI JOIN ({seen}) s ON s.source = f.source AND s.node = adj.b
            GROUP BY 1, 2"""
    ctes["r"] = " UNION ALL ".join(f"SELECT source, node, parent, {d} AS dist FROM l{d}" for d in range(depth + 1))
    return ctes


def hub_level_ctes(hubs: str, sources: str, depth: int) -> dict[str, str]:
    """The same levels on a graph of hubs, through memberships."""
    ctes = {"mem": hubs, "l0": f"SELECT source, source AS node, CAST(NULL AS BIGINT) AS parent FROM ({sources})"}
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT source, node FROM l{i}" for i in range(max(0, d - 2), d))
        ctes[f"l{d}"] = f"""SELECT h.source, m.node, MIN(h.parent) AS parent FROM (
                SELECT f.source, m.kind, m.hub, MIN(f.node) AS parent FROM l{d - 1} f JOIN mem m ON m.node = f.node
                GROUP BY 1, 2, 3) h JOIN mem m ON m.kind = h.kind AND m.hub = h.hub
            ANTI JOIN ({seen}) s ON s.source = h.source AND s.node = m.node GROUP BY 1, 2"""
    ctes["r"] = " UNION ALL ".join(f"SELECT source, node, parent, {d} AS dist FROM l{d}" for d in range(depth + 1))
    return ctes


# --- paths -------------------------------------------------------------------------------------

@query("bfs_distances", sql("""SELECT 'PART:' || source AS source_id, 'PART:' || node AS id, dist AS distance,
    'PART:' || parent AS parent_id FROM r""", extra=hub_level_ctes(
        PART_HUBS, "SELECT CAST(1 AS BIGINT) AS source", 6)))
def bfs_distances(t: Tables, source: int = START_PART) -> DataFrame:
    """Distance of every part reached from one part through shared orders and suppliers."""
    graph = load_graph(t, "part")
    seeds = t.spark.createDataFrame([(source,)], "source bigint")
    rows = traverse.all_levels(traverse.bfs_levels(graph, seeds))
    return rows.select(part_id("source").alias("source_id"), part_id("node").alias("id"),
                       F.col("dist").alias("distance"), part_id("parent").alias("parent_id"))


def node_path(node_type: str):
    """Path of typed ids, source first."""
    return F.array_join(F.transform("path", lambda n: typed_id(node_type, n)), " -> ")


def _path_rows(found: DataFrame, node_type: str) -> DataFrame:
    return found.select(typed_id(node_type, "source").alias("source_id"),
                        typed_id(node_type, "target").alias("target_id"), "status", "distance",
                        node_path(node_type).alias("path"))


def _path_sql(pairs: str, depth: int) -> str:
    """Paths by walking the parents back from each target."""
    walks = {"w0": f"""SELECT p.source, p.target, r.dist, p.target AS node,
        'PART:' || p.target AS path FROM ({pairs}) p LEFT JOIN r ON r.source = p.source AND r.node = p.target"""}
    for d in range(1, depth + 1):
        walks[f"w{d}"] = f"""SELECT w.source, w.target, w.dist, COALESCE(r.parent, w.node) AS node,
            CASE WHEN r.parent IS NULL THEN path ELSE 'PART:' || r.parent || ' -> ' || path END AS path
            FROM w{d - 1} w LEFT JOIN r ON r.source = w.source AND r.node = w.node"""
    return sql(f"""SELECT 'PART:' || source AS source_id, 'PART:' || target AS target_id,
        CASE WHEN dist IS NULL THEN 'NO_PATH' ELSE 'OK' END AS status, dist AS distance,
        CASE WHEN dist IS NOT NULL THEN path END AS path FROM w{depth}""",
               extra={**hub_level_ctes(PART_HUBS, f"SELECT DISTINCT source FROM ({pairs})", depth), **walks})


@query("shortest_path", _path_sql("SELECT CAST(1 AS BIGINT) AS source, CAST(2 AS BIGINT) AS target", 6))
def shortest_path(t: Tables, source: int = START_PART, target: int = END_PART,
                  graph_type: str = "part", relations=None) -> DataFrame:
    pair = t.spark.createDataFrame([(source, target)], "source bigint, target bigint")
    kind = {"part": "PART", "supplier": "SUPPLIER"}
    graph = load_graph(t, graph_type, relations)
    return _path_rows(traverse.shortest_paths(graph, pair), kind[graph_type])


@query("shortest_path_batch", _path_sql("""SELECT MIN(p_partkey) AS source, MAX(p_partkey) AS target FROM part
    GROUP BY p_brand""", 6))
def shortest_path_batch(t: Tables) -> DataFrame:
    """First and last part of every brand: all pairs in one search."""
    pairs = t.part.groupBy("p_brand").agg(F.min("p_partkey").alias("source"), F.max("p_partkey").alias("target"))
    return _path_rows(traverse.shortest_paths(load_graph(t, "part"), pairs), "PART")


def _weights(t: Tables) -> DataFrame:
    """Cost of a supplier pair: the more orders they met on, the closer they are."""
    return supplier_matches(t).select("a", "b", (F.lit(1.0) / F.col("links")).alias("w"))


def _relax_ctes(rounds: int) -> dict[str, str]:
    ctes = {"m": MATCH_SQL, "adj": """SELECT a, b, CAST(1 AS DOUBLE) / links AS w FROM m
                                      UNION ALL SELECT b, a, CAST(1 AS DOUBLE) / links FROM m""",
            "d0": "SELECT CAST(1 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS cost"}
    for i in range(1, rounds + 1):
        ctes[f"d{i}"] = f"""SELECT node, MIN(cost) AS cost FROM (SELECT node, cost FROM d{i - 1}
            UNION ALL SELECT adj.b, d.cost + w FROM d{i - 1} d JOIN adj ON adj.a = d.node) GROUP BY node"""
    return ctes


@query("shortest_path_weighted", sql("""SELECT 'SUPPLIER:1' AS source_id, 'SUPPLIER:' || node AS id,
    ROUND(cost, 9) AS cost FROM d12""", "matchups", extra=_relax_ctes(12)))
def shortest_path_weighted(t: Tables, source: int = START_SUPPLIER) -> DataFrame:
    """Least total cost from one supplier to every other over order matches."""
    weights = cut_lineage(_weights(t))
    graph = Graph(t.supplier.select(F.col("s_suppkey").alias("id")), pairs=weights.select("a", "b"))
    seeds = t.spark.createDataFrame([(source,)], "source bigint")
    costs = traverse.weighted_distances(graph, weights, seeds)
    return costs.select(supplier_id("source").alias("source_id"), supplier_id("node").alias("id"),
                        F.round("cost", 9).alias("cost"))


PART_HUB_SIZES = """SELECT mem.node, mem.kind, mem.hub, h.w FROM mem JOIN (
    SELECT kind, hub, COUNT(*) AS w FROM mem GROUP BY kind, hub) h ON h.kind = mem.kind AND h.hub = mem.hub"""


def _hub_relax_ctes(rounds: int) -> dict[str, str]:
    ctes = {"mem": PART_HUBS, "e": PART_HUB_SIZES, "d0": "SELECT CAST(1 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS cost"}
    for i in range(1, rounds + 1):
        ctes[f"d{i}"] = f"""SELECT node, MIN(cost) AS cost FROM (SELECT node, cost FROM d{i - 1}
            UNION ALL SELECT mem.node, h.cost FROM (SELECT e.kind, e.hub, MIN(d.cost + e.w) AS cost FROM d{i - 1} d
                JOIN e ON e.node = d.node GROUP BY 1, 2) h JOIN mem ON mem.kind = h.kind AND mem.hub = h.hub) GROUP BY node"""
    return ctes


@query("shortest_path_weighted_part", sql("""SELECT 'PART:1' AS source_id, 'PART:' || node AS id, cost FROM d12""",
                                          extra=_hub_relax_ctes(12)))
def shortest_path_weighted_part(t: Tables, source: int = START_PART) -> DataFrame:
    """Least total cost from one part to every other: a shared order or supplier costs as much as it has parts."""
    graph = load_graph(t, "part")
    sizes = graph.by_hub.groupBy("kind", "hub").agg(F.count("*").cast("double").alias("w"))
    seeds = t.spark.createDataFrame([(source,)], "source bigint")
    costs = traverse.weighted_distances(graph, None, seeds, hub_weights=sizes)
    return costs.select(part_id("source").alias("source_id"), part_id("node").alias("id"), "cost")


@query("supplier_network_depth", sql("""
    SELECT 'SUPPLIER:' || r.node AS supplier_id, r.dist AS degree, 'PART:' || adj.via AS via_part,
           'SUPPLIER:' || r.parent AS parent_id
    FROM r JOIN adj ON adj.a = r.parent AND adj.b = r.node WHERE r.dist > 0""", extra=level_ctes(
        CO_PART_ADJ, "SELECT CAST(1 AS BIGINT) AS source", 3)))
def supplier_network_depth(t: Tables, start: int = START_SUPPLIER,
                           max_degrees: int = MAX_SUPPLIER_DEGREES) -> DataFrame:
    """Suppliers within a few degrees of one supplier through shared parts."""
    graph = Graph(t.supplier.select(F.col("s_suppkey").alias("id")),
                  members=memberships(t.lineitem, "l_suppkey", "l_partkey", "part"))
    seeds = t.spark.createDataFrame([(start,)], "source bigint")
    rows = traverse.all_levels(traverse.bfs_levels(graph, seeds, max_degrees)).where("dist > 0")
    return traverse.with_hubs(rows, graph).select(
        supplier_id("node").alias("supplier_id"), F.col("dist").alias("degree"),
        part_id("via").alias("via_part"), supplier_id("parent").alias("parent_id"))


@query("supplier_network_paths", sql("""SELECT 'SUPPLIER:' || node AS supplier_id, degree, path FROM p1
    UNION ALL SELECT 'SUPPLIER:' || node, degree, path FROM p2 UNION ALL SELECT 'SUPPLIER:' || node, degree, path FROM p3""", extra={
        **level_ctes(CO_PART_ADJ, "SELECT CAST(1 AS BIGINT) AS source", 3),
        "p0": "SELECT CAST(1 AS BIGINT) AS node, 0 AS degree, 'SUPPLIER:1' AS path",
        **{f"p{d}": f"""SELECT l.node, {d} AS degree, p.path || ' → (PART:' || adj.via || ') → SUPPLIER:' || l.node AS path
            FROM l{d} l JOIN p{d - 1} p ON p.node = l.parent JOIN adj ON adj.a = l.parent AND adj.b = l.node""" for d in (1, 2, 3)}}))
def supplier_network_paths(t: Tables, start: int = START_SUPPLIER, max_degrees: int = MAX_SUPPLIER_DEGREES) -> DataFrame:
    """As above with the whole connection path, linking part in brackets."""
    graph = Graph(t.supplier.select(F.col("s_suppkey").alias("id")),
                  members=memberships(t.lineitem, "l_suppkey", "l_partkey", "part"))
    levels = traverse.bfs_levels(graph, t.spark.createDataFrame([(start,)], "source bigint"), max_degrees)
    pairs = traverse.distances(levels).where("dist > 0").select("source", F.col("node").alias("target"))
    step = F.transform("steps", lambda s: F.when(s["via"].isNull(), typed_id("SUPPLIER", s["node"])).otherwise(
        F.concat(F.lit("("), typed_id("PART", s["via"]), F.lit(") → "), typed_id("SUPPLIER", s["node"]))))
    return traverse.name_steps(traverse.walk_back(levels, pairs), graph).select(
        supplier_id("target").alias("supplier_id"), F.col("dist").alias("degree"),
        F.array_join(step, " → ").alias("path"))


@query("connection_path", sql("""
    SELECT 'PART:' || r.source AS source_id, 'PART:' || r.node AS target_id, 'OK' AS status,
           r.dist AS distance, 'PART:1 → SUPPLIER:' || adj.via || ' → PART:2' AS path
    FROM r JOIN adj ON adj.a = r.parent AND adj.b = r.node WHERE r.node = 2 AND r.dist = 1
    UNION ALL
    SELECT 'PART:' || y.source, 'PART:' || y.node, 'OK', y.dist, 'PART:1 → SUPPLIER:' || e.via ||
           ' → PART:' || y.parent || ' → SUPPLIER:' || f.via || ' → PART:2'
    FROM r y JOIN adj f ON f.a = y.parent AND f.b = y.node JOIN adj e ON e.a = 1 AND e.b = y.parent
    WHERE y.node = 2 AND y.dist = 2""", extra=level_ctes(
        CO_SUPPLIER_ADJ, "SELECT CAST(1 AS BIGINT) AS source", 2)))
def connection_path(t: Tables, source: int = START_PART, target: int = END_PART) -> DataFrame:
    """How two parts connect through shared suppliers, with the suppliers on the way."""
    pair = t.spark.createDataFrame([(source, target)], "source bigint, target bigint")
    found = traverse.shortest_paths(load_graph(t, "part", ("supplier",)), pair, MAX_PART_HOPS, name_hubs=True)
    step = F.transform("steps", lambda s: F.when(s["via"].isNull(), typed_id("PART", s["node"])).otherwise(
        F.concat(typed_id("SUPPLIER", s["via"]), F.lit(" → "), typed_id("PART", s["node"]))))
    return found.select(part_id("source").alias("source_id"), part_id("target").alias("target_id"), "status",
                        "distance", F.array_join(step, " → ").alias("path"))


# --- centralities and communities ----------------------------------------------------------------

N_SUPPLIERS = "(SELECT COUNT(*) FROM supplier)"


def _scores(scores: DataFrame) -> DataFrame:
    return scores.select(supplier_id("id").alias("id"), F.round("score", 9).alias("score"))


@query("centrality_degree", sql(f"""
    SELECT 'SUPPLIER:' || s_suppkey AS id, ROUND(COALESCE(n, 0) / ({N_SUPPLIERS} - 1), 9) AS score
    FROM supplier LEFT JOIN (SELECT a, COUNT(*) AS n FROM adj GROUP BY a) d ON d.a = s_suppkey""",
                                "matchups", "supplied_by", extra={**PART_RANKED, "adj": SUPPLIER_ADJ}))
def centrality_degree(t: Tables) -> DataFrame:
    return _scores(centrality.degree(load_graph(t, "supplier")))


@query("centrality_closeness", sql(f"""
    SELECT 'SUPPLIER:' || s_suppkey AS id, ROUND(COALESCE((CAST(n AS DOUBLE) / s) *
           (CAST(n AS DOUBLE) / ({N_SUPPLIERS} - 1)), 0), 9) AS score
    FROM supplier LEFT JOIN (SELECT source, COUNT(*) AS n, SUM(dist) AS s FROM r WHERE dist > 0 GROUP BY source) d
      ON d.source = s_suppkey""", "matchups", "supplied_by", extra={**PART_RANKED, **level_ctes(
        SUPPLIER_ADJ, "SELECT s_suppkey AS source FROM supplier", 6)}))
def centrality_closeness(t: Tables) -> DataFrame:
    return _scores(centrality.closeness(load_graph(t, "supplier")))


CLOSENESS_SQL = f"""SELECT source AS node, COUNT(*) AS n, SUM(dist) AS s FROM r WHERE dist > 0 GROUP BY source"""


@query("centrality_closeness_sketched", sql(f"""
    SELECT 'SUPPLIER:' || s_suppkey AS id, ROUND(COALESCE((CAST(n AS DOUBLE) / s) * (CAST(n AS DOUBLE) / ({N_SUPPLIERS} - 1)), 0), 9) AS score,
           COALESCE(n, 0) + 1 AS reached
    FROM supplier LEFT JOIN ({CLOSENESS_SQL}) d ON d.node = s_suppkey""", "matchups", "supplied_by", extra={
        **PART_RANKED, **level_ctes(SUPPLIER_ADJ, "SELECT s_suppkey AS source FROM supplier", 6)}))
def centrality_closeness_sketched(t: Tables) -> DataFrame:
    """Closeness of all suppliers from distinct-count sketches, one row per supplier at any size."""
    found = centrality.closeness_by_sketches(load_graph(t, "supplier"))
    return found.select(supplier_id("id").alias("id"), F.round("score", 9).alias("score"), "reached")


@query("closeness_of_parts", sql(f"""
    SELECT 'PART:' || p.source AS id, ROUND(COALESCE((CAST(n AS DOUBLE) / s) * (CAST(n AS DOUBLE) / ((SELECT COUNT(*) FROM part) - 1)), 0), 9) AS score
    FROM (SELECT MIN(p_partkey) AS source FROM part GROUP BY p_brand) p LEFT JOIN ({CLOSENESS_SQL}) d ON d.node = p.source""",
                                 extra=hub_level_ctes(PART_HUBS, "SELECT MIN(p_partkey) AS source FROM part GROUP BY p_brand", 6)))
def closeness_of_parts(t: Tables, sources: DataFrame | None = None) -> DataFrame:
    """Exact closeness of named parts, by default the first part of every brand."""
    named = sources if sources is not None else t.part.groupBy("p_brand").agg(F.min("p_partkey").alias("source")).select("source")
    found = centrality.closeness(load_graph(t, "part"), sources=named)
    return found.select(part_id("id").alias("id"), F.round("score", 9).alias("score"))


def _sigma_ctes(depth: int) -> dict[str, str]:
    """Shortest-path counts g(source, node, dist, sigma) by unrolled levels."""
    ctes = {"adj": SUPPLIER_ADJ,
            "s0": "SELECT s_suppkey AS source, s_suppkey AS node, CAST(1 AS DOUBLE) AS sigma FROM supplier"}
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT source, node FROM s{i}" for i in range(max(0, d - 2), d))
        ctes[f"s{d}"] = f"""SELECT f.source, adj.b AS node, SUM(f.sigma) AS sigma FROM s{d - 1} f
            JOIN adj ON adj.a = f.node ANTI JOIN ({seen}) x ON x.source = f.source AND x.node = adj.b
            GROUP BY 1, 2"""
    ctes["g"] = " UNION ALL ".join(f"SELECT source, node, sigma, {d} AS dist FROM s{d}" for d in range(depth + 1))
    return ctes


@query("centrality_betweenness", sql(f"""
    SELECT 'SUPPLIER:' || s_suppkey AS id, ROUND(COALESCE(c, 0) * 2 /
           (({N_SUPPLIERS} - 1) * ({N_SUPPLIERS} - 2)), 9) AS score
    FROM supplier LEFT JOIN (
      SELECT x.node AS v, SUM(x.sigma * y.sigma / st.sigma) AS c
      FROM g st JOIN g x ON x.source = st.source JOIN g y ON y.source = st.node AND y.node = x.node
      WHERE st.source < st.node AND x.node <> st.source AND x.node <> st.node
        AND x.dist + y.dist = st.dist GROUP BY x.node) b ON b.v = s_suppkey""", "matchups", "supplied_by",
                                     extra={**PART_RANKED, **_sigma_ctes(6)}))
def centrality_betweenness(t: Tables) -> DataFrame:
    return _scores(centrality.betweenness(load_graph(t, "supplier")))


@query("centrality_betweenness_pivots", sql(f"""
    SELECT 'SUPPLIER:' || s_suppkey AS id, ROUND(COALESCE(c, 0) * 2 / (({N_SUPPLIERS} - 1) * ({N_SUPPLIERS} - 2)), 9) AS score,
           {N_SUPPLIERS} AS pivots
    FROM supplier LEFT JOIN (
      SELECT x.node AS v, SUM(x.sigma * y.sigma / st.sigma) AS c
      FROM g st JOIN g x ON x.source = st.source JOIN g y ON y.source = st.node AND y.node = x.node
      WHERE st.source < st.node AND x.node <> st.source AND x.node <> st.node
        AND x.dist + y.dist = st.dist GROUP BY x.node) b ON b.v = s_suppkey""", "matchups", "supplied_by",
                                            extra={**PART_RANKED, **_sigma_ctes(6)}))
def centrality_betweenness_pivots(t: Tables, error: float = 0.01) -> DataFrame:
    """Betweenness from as many sampled suppliers as the error bound asks for; of few suppliers it asks for all."""
    found = centrality.betweenness_by_pivots(load_graph(t, "supplier"), error)
    return found.select(supplier_id("id").alias("id"), F.round("score", 9).alias("score"), "pivots")


@query("centrality_degree_part", sql("""
    SELECT 'PART:' || p_partkey AS id, ROUND(COALESCE(n, 0) / ((SELECT COUNT(*) FROM part) - 1), 9) AS score
    FROM part LEFT JOIN (
        SELECT mem.node, CAST(SUM(h.n - 1) AS DOUBLE) AS n FROM mem
        JOIN (SELECT kind, hub, COUNT(*) AS n FROM mem GROUP BY kind, hub) h ON h.kind = mem.kind AND h.hub = mem.hub
        GROUP BY mem.node) d ON d.node = p_partkey""", extra={"mem": PART_HUBS}))
def centrality_degree_part(t: Tables, relations=None) -> DataFrame:
    """Degree of every part among the parts it shares orders and suppliers with, once per shared one."""
    scores = centrality.degree(load_graph(t, "part", relations))
    return scores.select(part_id("id").alias("id"), F.round("score", 9).alias("score"))


SETTLED = 1e-10  # mean change per score at which the registered power iterations stop


def _power_sql(nodes: str, adj: str, prefix: str, steps: int = 40) -> str:
    """Power iteration on A + I for a fixed number of steps, brought to unit length at the end."""
    ctes = sql("", "matchups", "supplied_by", extra={
        **PART_RANKED, "mem": PART_HUBS, "adj": adj,
        "own": f"SELECT id, id AS other, 1 AS w FROM ({nodes}) UNION ALL SELECT a, b, w FROM adj"})
    return f"""{ctes.replace("WITH", "WITH RECURSIVE", 1)}, it AS (
            SELECT id, CAST(1 AS DOUBLE) AS v, 0 AS step FROM ({nodes})
            UNION ALL SELECT own.id, SUM(it.v * own.w) / 100, ANY_VALUE(it.step) + 1 FROM it JOIN own ON own.other = it.id
            WHERE it.step < {steps} GROUP BY own.id)
        SELECT '{prefix}:' || id AS id, ROUND(v / (SELECT SQRT(SUM(v * v)) FROM it WHERE step = {steps}), 6) AS score
        FROM it WHERE step = {steps}"""


@query("centrality_eigenvector_part", _power_sql("SELECT p_partkey AS id FROM part", """
    SELECT x.node AS a, y.node AS b, COUNT(*) AS w FROM mem x JOIN mem y
      ON y.kind = x.kind AND y.hub = x.hub AND y.node <> x.node GROUP BY 1, 2""", "PART"))
def centrality_eigenvector_part(t: Tables, relations=None) -> DataFrame:
    scores = centrality.eigenvector(load_graph(t, "part", relations), tolerance=SETTLED)
    return scores.select(part_id("id").alias("id"), F.round("score", 6).alias("score"))


@query("centrality_eigenvector", _power_sql("SELECT s_suppkey AS id FROM supplier",
                                            f"SELECT a, b, 1 AS w FROM ({SUPPLIER_ADJ})", "SUPPLIER"))
def centrality_eigenvector(t: Tables) -> DataFrame:
    scores = centrality.eigenvector(load_graph(t, "supplier"), tolerance=SETTLED)
    return scores.select(supplier_id("id").alias("id"), F.round("score", 6).alias("score"))


@query("centrality_top", sql(f"""
    SELECT 'SUPPLIER:' || s_suppkey AS id, s_name AS name, ROUND(n / ({N_SUPPLIERS} - 1), 9) AS score
    FROM supplier JOIN (SELECT a, COUNT(*) AS n FROM adj GROUP BY a) d ON d.a = s_suppkey
    ORDER BY n DESC, s_suppkey LIMIT 10""", "matchups", "supplied_by", extra={**PART_RANKED, "adj": SUPPLIER_ADJ}))
def centrality_top(t: Tables, graph_type: str = "supplier", method: str = "degree",
                   top_n: int = 10, relations=None) -> DataFrame:
    """Top parts or suppliers by a centrality, with their names."""
    top = centrality.top_central(load_graph(t, graph_type, relations), method, top_n)
    key, name = {"part": ("p_partkey", "p_name"), "supplier": ("s_suppkey", "s_name")}[graph_type]
    names = t.read(graph_type).select(F.col(key).alias("id"), F.col(name).alias("name"))
    return top.join(names, "id").select(typed_id(graph_type.upper(), "id").alias("id"), "name",
                                        F.round("score", 9).alias("score"))


@query("community_louvain")
def community_louvain(t: Tables) -> DataFrame:
    found = community.louvain(load_graph(t, "supplier"))
    return found.select(supplier_id("id").alias("id"), supplier_id("community_id").alias("community_id"))


@query("community_sizes")
def community_sizes(t: Tables) -> DataFrame:
    sizes = community.community_sizes(community.louvain(load_graph(t, "supplier")))
    return sizes.select(supplier_id("community_id").alias("community_id"), "size")


@query("community_invariants", """
    SELECT (SELECT COUNT(*) FROM supplier) AS nodes, TRUE AS each_node_once, TRUE AS named_by_smallest_member,
           TRUE AS at_least_as_good_as_one_community""")
def community_invariants(t: Tables) -> DataFrame:
    """What any outcome of the community search must satisfy, on the whole supplier graph."""
    graph = load_graph(t, "supplier")
    found = cut_lineage(community.louvain(graph))
    per = found.groupBy("community_id").agg(F.min("id").alias("low"))
    good = community.modularity(graph, found) >= -1e-12  # one community of all nodes has modularity 0
    return found.agg(F.count("*").alias("nodes"), (F.count("*") == F.count_distinct("id")).alias("each_node_once")).join(
        per.agg(F.min(F.col("community_id") == F.col("low")).alias("named_by_smallest_member")), how="cross").withColumn(
        "at_least_as_good_as_one_community", F.lit(good))


# --- movement and time ------------------------------------------------------------------------

@query("moves_for_supplier", sql("""
    SELECT 'SUPPLIER:' || supp_key AS supplier_id, 'PART:' || e.part_key AS other_id, part_name AS name,
           start_date, end_date, COALESCE(CAST(value AS DOUBLE), 0) AS value
    FROM supplied_by e JOIN part_dim p ON p.part_key = e.part_key""", "supplied_by", "part_dim"))
def moves_for_supplier(t: Tables, supplier: int | None = None, first=None, last=None) -> DataFrame:
    rows = temporal.within(b.supplied_by(t), first, last)
    if supplier is not None:
        rows = rows.where(F.col("supp_key") == supplier)
    return rows.join(b.part_dim(t), "part_key").select(
        supplier_id().alias("supplier_id"), part_id().alias("other_id"), F.col("part_name").alias("name"),
        "start_date", "end_date", F.coalesce(b.money("cents"), F.lit(0.0)).alias("value"))


@query("moves_for_part", sql("""
    SELECT 'PART:' || part_key AS part_id, 'SUPPLIER:' || e.supp_key AS other_id, supplier_name AS name,
           start_date, end_date, COALESCE(CAST(value AS DOUBLE), 0) AS value
    FROM supplied_by e JOIN supplier_dim s ON s.supp_key = e.supp_key""", "supplied_by", "supplier_dim"))
def moves_for_part(t: Tables, part: int | None = None, first=None, last=None) -> DataFrame:
    rows = temporal.within(b.supplied_by(t), first, last)
    if part is not None:
        rows = rows.where(F.col("part_key") == part)
    return rows.join(b.supplier_dim(t), "supp_key").select(
        part_id().alias("part_id"), supplier_id().alias("other_id"), F.col("supplier_name").alias("name"),
        "start_date", "end_date", F.coalesce(b.money("cents"), F.lit(0.0)).alias("value"))


@query("temporal_evolution", sql("""
    SELECT CAST(YEAR(start_date) AS INT) AS year, COUNT(DISTINCT part_key) AS unique_parts,
           COUNT(DISTINCT supp_key) AS unique_suppliers, CAST(SUM(value) AS DOUBLE) AS total_value
    FROM supplied_by GROUP BY 1""", "supplied_by"))
def temporal_evolution(t: Tables, first=None, last=None) -> DataFrame:
    yearly = temporal.evolution(temporal.within(b.supplied_by(t), first, last), "part_key", "supp_key", "cents")
    return yearly.select("year", F.col("entities").alias("unique_parts"),
                         F.col("members").alias("unique_suppliers"),
                         b.money("total").alias("total_value"))


@query("temporal_trends", sql("""
    SELECT 'SUPPLIER:' || e.supp_key AS supplier_id, supplier_name AS name, COUNT(*) AS move_count
    FROM supplied_by e JOIN supplier_dim s ON s.supp_key = e.supp_key
    GROUP BY e.supp_key, supplier_name ORDER BY move_count DESC, e.supp_key LIMIT 10""",
                              "supplied_by", "supplier_dim"))
def temporal_trends(t: Tables, n: int = 10) -> DataFrame:
    """Names are looked up for the ten winners only."""
    names = t.supplier.select(F.col("s_suppkey").alias("supp_key"), F.col("s_name").alias("name"))
    return temporal.busiest(b.supplied_by(t), "supp_key", n).join(names, "supp_key").select(
        supplier_id().alias("supplier_id"), "name", "move_count")


@query("temporal_patterns", sql("""
    SELECT *, LAG(moves) OVER (PARTITION BY from_nation, to_nation ORDER BY year) AS previous_moves,
           moves - LAG(moves) OVER (PARTITION BY from_nation, to_nation ORDER BY year) AS change
    FROM (SELECT a.nation AS from_nation, c.nation AS to_nation, CAST(YEAR(start_date) AS INT) AS year,
                 COUNT(*) AS moves
          FROM ranked r JOIN supplier_dim a ON a.supp_key = prev_member
          JOIN supplier_dim c ON c.supp_key = r.supp_key WHERE prev_end < start_date GROUP BY 1, 2, 3)""",
                                "supplied_by", "supplier_dim", extra=PART_RANKED))
def temporal_patterns(t: Tables) -> DataFrame:
    """Whether the corridors between nations get stronger or weaker."""
    dim = b.supplier_dim(t)
    old = dim.select(F.col("supp_key").alias("from_member"), F.col("nation").alias("from_nation"))
    new = dim.select(F.col("supp_key").alias("to_member"), F.col("nation").alias("to_nation"))
    steps = part_moves(t).join(old, "from_member").join(new, "to_member")
    return temporal.corridors(steps, "from_nation", "to_nation", "joined_date").select(
        "from_nation", "to_nation", "year", "moves", "previous_moves", "change")


@query("network_by_year", sql("""
    SELECT e.year, n.nodes, e.edges,
           CASE WHEN n.nodes > 1 THEN 2 * CAST(e.edges AS DOUBLE) / (CAST(n.nodes AS DOUBLE) * (n.nodes - 1))
                ELSE 0 END AS density, 2 * CAST(e.edges AS DOUBLE) / n.nodes AS mean_degree
    FROM (SELECT year, COUNT(*) AS edges FROM p GROUP BY year) e
    JOIN (SELECT year, COUNT(DISTINCT k) AS nodes FROM (SELECT year, x AS k FROM p UNION ALL SELECT year, y FROM p)
          GROUP BY year) n ON n.year = e.year""", "matchups", "order_dim", extra={
        "p": """SELECT DISTINCT CAST(YEAR(order_date) AS INT) AS year, LEAST(lead_key, tail_key) AS x,
                GREATEST(lead_key, tail_key) AS y FROM matchups m JOIN order_dim o ON o.order_key = m.order_key"""}))
def network_by_year(t: Tables) -> DataFrame:
    """Size and density of the supplier network in each order year."""
    dated = b.matchups(t).join(b.order_dim(t).select("order_key", "order_date"), "order_key")
    return temporal.yearly_network(dated, "lead_key", "tail_key", "order_date")
