"""Graph operators against textbook computations on small graphs."""

import itertools
import math
import os
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.operators.graph import centrality, community, traverse
from kgspark.operators.graph.build import (Graph, Neighbours, canonical_pairs, first_relation_wins,
                                           hub_sizes, memberships)
from kgspark.session import bucketed, cut_lineage

# a 4-cycle with a tail, a triangle apart from it, and an isolated node
EDGES = [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4), (4, 5), (10, 11), (11, 12), (10, 12)]
NODES = [0, 1, 2, 3, 4, 5, 10, 11, 12, 20]


def neighbours(edges, nodes):
    adj = {n: set() for n in nodes}
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    return adj


def search(adj, s):
    dist, sigma, order = {s: 0}, {s: 1}, [s]
    queue = deque([s])
    while queue:
        u = queue.popleft()
        for v in adj[u]:
            if v not in dist:
                dist[v], sigma[v] = dist[u] + 1, 0
                queue.append(v)
                order.append(v)
            if dist[v] == dist[u] + 1:
                sigma[v] += sigma[u]
    return dist, sigma, order


def make(spark, edges, nodes):
    return Graph(spark.createDataFrame([(n,) for n in nodes], "id bigint"),
                 pairs=spark.createDataFrame([(min(e), max(e)) for e in edges], "a bigint, b bigint"))


@pytest.fixture(scope="module")
def graph(spark):
    return make(spark, EDGES, NODES)


@pytest.fixture(scope="module")
def hub_graph(spark):
    """Members of hubs; the same neighbours as the pair graph built from them."""
    rng = random.Random(5)
    rows = [(n, "h", h) for h in range(7) for n in rng.sample(range(14), rng.randint(1, 4))]
    rows += [(n, "g", 1) for n in (2, 13)]
    pairs = {tuple(sorted(p)) for k in {r[1:] for r in rows}
             for p in itertools.combinations([r[0] for r in rows if r[1:] == k], 2)}
    nodes = list(range(15))
    return (Graph(spark.createDataFrame([(n,) for n in nodes], "id bigint"),
                  members=spark.createDataFrame(rows, "node bigint, kind string, hub bigint")),
            neighbours(pairs, nodes), nodes)


def scores(df):
    return {r.id: r.score for r in df.collect()}


def test_degree(graph):
    adj = neighbours(EDGES, NODES)
    assert scores(centrality.degree(graph)) == {n: len(adj[n]) / 9 for n in NODES}


@pytest.mark.parametrize("per_batch", [3, 100])
def test_closeness(graph, per_batch):
    adj = neighbours(EDGES, NODES)
    got = scores(centrality.closeness(graph, per_batch))
    for n in NODES:
        dist = search(adj, n)[0]
        r, total = len(dist) - 1, sum(dist.values())
        assert got[n] == pytest.approx(r / total * r / 9 if total else 0.0)


@pytest.mark.parametrize("per_batch", [4, 100])
def test_betweenness(graph, per_batch):
    adj = neighbours(EDGES, NODES)
    info = {n: search(adj, n) for n in NODES}
    got = scores(centrality.betweenness(graph, per_batch))
    for v in NODES:
        total = 0.0
        for s, t in itertools.combinations(NODES, 2):
            if v in (s, t) or t not in info[s][0] or v not in info[s][0]:
                continue
            if info[s][0][v] + info[v][0].get(t, 99) == info[s][0][t]:
                total += info[s][1][v] * info[v][1][t] / info[s][1][t]
        assert got[v] == pytest.approx(total * 2 / (9 * 8))


def test_eigenvector(spark):
    edges = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (1, 4)]
    got = scores(centrality.eigenvector(make(spark, edges, range(5))))
    a = np.zeros((5, 5))
    for x, y in edges:
        a[x, y] = a[y, x] = 1
    vector = np.array([got[i] for i in range(5)])
    value = vector @ a @ vector
    assert math.isclose(float(vector @ vector), 1.0, rel_tol=1e-9)
    assert np.abs(a @ vector - value * vector).max() < 1e-3
    assert abs(value - np.linalg.eigvalsh(a).max()) < 1e-3
    with pytest.raises(RuntimeError):
        centrality.eigenvector(make(spark, edges, range(5)), max_steps=1)


def test_top_central(graph):
    top = [r.id for r in centrality.top_central(graph, "degree", 3).collect()]
    assert top == [3, 0, 1]  # ties go to the smaller id
    with pytest.raises(ValueError):
        centrality.top_central(graph, "pagerank")


def test_louvain(spark, graph):
    cliques = [e for base in (0, 10, 20) for e in itertools.combinations(range(base, base + 5), 2)]
    ring = cliques + [(4, 10), (14, 20), (24, 0)]
    nodes = [b + i for b in (0, 10, 20) for i in range(5)] + [99]
    g = make(spark, ring, nodes)
    found = {r.id: r.community_id for r in community.louvain(g).collect()}
    assert found == {**{b + i: b for b in (0, 10, 20) for i in range(5)}, 99: 99}
    part = spark.createDataFrame(list(found.items()), "id bigint, community_id bigint")
    one = spark.createDataFrame([(n, 0) for n in nodes], "id bigint, community_id bigint")
    assert community.modularity(g, part) > community.modularity(g, one)
    again = {r.id: r.community_id for r in community.louvain(g).collect()}
    assert again == found
    assert sorted(r["size"] for r in community.community_sizes(part).collect()) == [1, 5, 5, 5]


def test_louvain_rounds_move_no_edges(spark):
    """A round joins and adds up the edges where they lie; only rows of nodes are moved."""
    edges = spark.createDataFrame([(a, b, 1.0) for x, y in EDGES for a, b in ((x, y), (y, x))], "src bigint, dst bigint, w double")
    state = cut_lineage(edges.groupBy("src").agg(F.sum("w").alias("k")).select(
        F.col("src").alias("id"), F.col("src").alias("comm"), "k", F.lit(0.0).alias("loop"), F.lit(0).alias("turn")))
    dealt = bucketed(edges, "src", buckets=2)
    plan = community._decide(dealt, state, float(2 * len(EDGES)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("src#" in line for line in moved) and "Bucketed: true" in text
    found = {r.id: r for r in plan.collect()}
    adj = neighbours(EDGES, NODES)
    assert set(found) == {n for n in NODES if adj[n]}
    for n, r in found.items():
        gains = {m: round(1 - len(adj[n]) * len(adj[m]) / (2 * len(EDGES)), 9) for m in adj[n]}
        assert (r.k_own, r.k, r.own_tot) == (0, len(adj[n]), len(adj[n]))
        assert (r.best.gain, -r.best.neg) == (max(gains.values()), min(m for m in gains if gains[m] == max(gains.values())))


def test_bfs_pairs(graph, spark):
    adj = neighbours(EDGES, NODES)
    seeds = spark.createDataFrame([(0,), (10,), (20,), (77,)], "source bigint")
    got = {(r.source, r.node): r.dist for r in traverse.distances(traverse.bfs_levels(graph, seeds)).collect()}
    want = {(s, n): d for s in (0, 10, 20) for n, d in search(adj, s)[0].items()}
    assert got == want  # 77 is no node of the graph


def test_bfs_through_hubs(hub_graph, spark):
    graph, adj, nodes = hub_graph
    seeds = spark.createDataFrame([(n,) for n in nodes], "source bigint")
    levels = traverse.bfs_levels(graph, seeds)
    got = {(r.source, r.node): r.dist for r in traverse.distances(levels).collect()}
    assert got == {(s, n): d for s in nodes for n, d in search(adj, s)[0].items()}
    for level in levels[1:]:
        for r in level.collect():
            dist = search(adj, r.source)[0]
            assert r.parent == min(p for p in adj[r.node] if dist.get(p) == r.dist - 1)


def test_bfs_depth_bound(graph, spark):
    seeds = spark.createDataFrame([(0,)], "source bigint")
    reached = traverse.distances(traverse.bfs_levels(graph, seeds, max_depth=2))
    assert max(r.dist for r in reached.collect()) == 2


def test_shortest_paths(graph, spark):
    pairs = spark.createDataFrame([(0, 5), (0, 2), (0, 10), (0, 77), (77, 0), (4, 4)],
                                  "source bigint, target bigint")
    rows = {(r.source, r.target): (r.status, r.distance, r.path)
            for r in traverse.shortest_paths(graph, pairs).collect()}
    assert rows == {(0, 5): ("OK", 3, [0, 3, 4, 5]), (0, 2): ("OK", 2, [0, 1, 2]),
                    (0, 10): ("NO_PATH", None, None), (0, 77): ("UNKNOWN_NODE", None, None),
                    (77, 0): ("UNKNOWN_NODE", None, None), (4, 4): ("OK", 0, [4])}


def smallest_parents(adj, s, t):
    """The path that takes the smallest parent at every step back from the target."""
    dist, path = search(adj, s)[0], [t]
    if t not in dist:
        return None
    while path[0] != s:
        path.insert(0, min(p for p in adj[path[0]] if dist.get(p) == dist[path[0]] - 1))
    return path


def test_search_from_both_ends(hub_graph, spark):
    """Every pair at once, through hubs, and through hubs and pair edges that make long ways."""
    graph, adj, nodes = hub_graph
    chain = [(100 + i, 101 + i) for i in range(9)] + [(0, 100), (104, 7), (200, 201)]
    more = nodes + list(range(100, 110)) + [200, 201]
    mixed = Graph(spark.createDataFrame([(n,) for n in more], "id bigint"), members=graph.members,
                  pairs=spark.createDataFrame(chain, "a bigint, b bigint"))
    wide = neighbours([(a, b) for a in adj for b in adj[a]] + chain, more)
    for g, near, ids in ((graph, adj, nodes), (mixed, wide, more)):
        pairs = spark.createDataFrame(list(itertools.product(ids, ids)), "source bigint, target bigint")
        rows = traverse.shortest_paths(g, pairs).collect()
        assert len(rows) == len(ids) ** 2
        for r in rows:
            want = smallest_parents(near, r.source, r.target)
            assert (r.status, r.distance, r.path) == (("OK", len(want) - 1, want) if want else ("NO_PATH", None, None))
    short = {(r.source, r.target): r.distance for r in traverse.shortest_paths(mixed, pairs, max_depth=2).collect()}
    assert all(short[s, t] == (len(p) - 1 if (p := smallest_parents(wide, s, t)) and len(p) <= 3 else None) for s, t in short)


def test_both_ends_touch_less(spark):
    rng = random.Random(8)
    rows = {(rng.randrange(3000), "h", h) for h in range(1500) for _ in range(5)}
    graph = Graph(spark.range(3000), members=spark.createDataFrame(list(rows), "node bigint, kind string, hub bigint"))
    pairs = spark.createDataFrame([(i, 2999 - i) for i in range(6)], "source bigint, target bigint")
    effort = []
    found = traverse.shortest_paths(graph, pairs, effort=effort).collect()
    levels = traverse.bfs_levels(graph, pairs.select("source"), None, pairs)
    reached = traverse.distances(levels).collect()
    known = {(r.source, r.node): r.dist for r in reached}
    assert all(r.distance == known.get((r.source, r.target)) for r in found)
    held = {}
    for n, _, _ in rows:
        held[n] = held.get(n, 0) + 1
    one_ended = sum(held.get(r.node, 0) for r in reached if r.dist < len(levels) - 1)  # memberships of all expanded nodes
    assert 0 < sum(effort[::2]) < one_ended / 2


def test_loops_leave_the_graph_in_place(hub_graph, spark):
    graph, _, nodes = hub_graph
    front = spark.createDataFrame([(1, n, "gh"[n % 2]) for n in nodes], "source bigint, node bigint, kind string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for plan in (front.drop("kind").join(graph.by_node, "node"), front.selectExpr("source", "kind", "node AS hub").join(graph.by_hub, ["kind", "hub"])):
            text = plan._jdf.queryExecution().executedPlan().toString()
            assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("width", [None, 0.5, 3.0, 100.0])
def test_weights_through_hubs(hub_graph, spark, width):
    graph, _, nodes = hub_graph
    rows = [(r.node, r.kind, r.hub) for r in graph.members.collect()]
    cost = {h: float(1 + (h[1] * 7) % 5) for h in {(k, h) for _, k, h in rows}}
    pairs = [(0, 14, 2.5), (3, 14, 0.25)]
    best = {a: {a: 0.0} for a in nodes}
    for a in nodes:
        for _ in nodes:
            for h, w in cost.items():
                members = [n for n, k, x in rows if (k, x) == h]
                low = min((best[a][m] for m in members if m in best[a]), default=None)
                for m in members if low is not None else ():
                    best[a][m] = min(best[a].get(m, 1e9), low + w)
            for x, y, w in pairs:
                for u, v in ((x, y), (y, x)):
                    if u in best[a]:
                        best[a][v] = min(best[a].get(v, 1e9), best[a][u] + w)
    got = {}
    frame = spark.createDataFrame([(*h, w) for h, w in cost.items()], "kind string, hub bigint, w double")
    weights = spark.createDataFrame(pairs, "a bigint, b bigint, w double")
    for r in traverse.weighted_distances(graph, weights, spark.createDataFrame([(n,) for n in nodes], "source bigint"), frame, width).collect():
        got.setdefault(r.source, {})[r.node] = r.cost
    assert got == best


def test_paths_name_the_hubs(spark):
    members = spark.createDataFrame([(1, "s", 7), (2, "s", 7), (2, "s", 8), (3, "s", 8)],
                                    "node bigint, kind string, hub bigint")
    graph = Graph(spark.createDataFrame([(1,), (2,), (3,)], "id bigint"), members=members)
    pair = spark.createDataFrame([(1, 3)], "source bigint, target bigint")
    row = traverse.shortest_paths(graph, pair, name_hubs=True).first()
    assert [(s.node, s.via) for s in row.steps] == [(1, None), (2, 7), (3, 8)]


def test_weighted_distances(spark):
    weights = [(0, 1, 4.0), (0, 2, 1.0), (1, 2, 2.0), (1, 3, 5.0), (2, 3, 8.0), (4, 5, 1.0)]
    g = make(spark, [(a, b) for a, b, _ in weights], range(6))
    w = spark.createDataFrame(weights, "a bigint, b bigint, w double")
    got = {r.node: r.cost for r in traverse.weighted_distances(
        g, w, spark.createDataFrame([(0,)], "source bigint")).collect()}
    assert got == {0: 0.0, 1: 3.0, 2: 1.0, 3: 8.0}


def test_building(spark):
    links = spark.createDataFrame([(1, 2, 9), (2, 1, 5), (3, 3, 1), (2, 3, 4)], "x bigint, y bigint, v bigint")
    first = canonical_pairs(links, "x", "y", "v", "match")
    assert sorted((r.a, r.b, r.via, r.links) for r in first.collect()) == [(1, 2, 5, 2), (2, 3, 4, 1)]
    second = canonical_pairs(spark.createDataFrame([(1, 2, 1), (1, 3, 1)], "x bigint, y bigint, v bigint"),
                             "x", "y", "v", "move")
    merged = {(r.a, r.b): (r.relationship, r.via, r.links)
              for r in first_relation_wins([first, second]).collect()}
    assert merged == {(1, 2): ("match", 5, 3), (2, 3): ("match", 4, 1), (1, 3): ("move", 1, 1)}
    rows = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (3, 8)], "n bigint, h bigint")
    assert sorted((r.hub, r.members, r.pairs) for r in hub_sizes(memberships(rows, "n", "h", "k")).collect()) == [
        (7, 2, 1), (8, 1, 0)]


def hub_weights(graph):
    """Shared hubs of every pair of nodes."""
    hubs, shared = {}, {}
    for r in graph.members.collect():
        hubs.setdefault((r.kind, r.hub), []).append(r.node)
    for members in hubs.values():
        for a, b in itertools.permutations(members, 2):
            shared[a, b] = shared.get((a, b), 0) + 1
    return shared


def test_hub_sums_weigh_shared_hubs(hub_graph, spark):
    graph, adj, nodes = hub_graph
    w = hub_weights(graph)
    values = spark.createDataFrame([("k", n, float(n + 1)) for n in nodes], "source string, node bigint, v double")
    got = {r.node: r.v for r in Neighbours(graph).total(values, ("source",)).collect() if abs(r.v) > 1e-9}
    assert got == {n: pytest.approx(sum(w[m, n] * (m + 1) for m in adj[n])) for n in nodes if adj[n]}


def test_hub_graph_centralities(hub_graph):
    graph, adj, nodes = hub_graph
    w = hub_weights(graph)
    assert scores(centrality.degree(graph)) == {n: sum(w[m, n] for m in adj[n]) / 14 for n in nodes}
    got = scores(centrality.closeness(graph))
    between = scores(centrality.betweenness(graph))
    info = {}
    for s in nodes:
        dist, _, order = search(adj, s)
        sigma = {s: 1}
        for v in order[1:]:
            sigma[v] = sum(sigma[u] * w[u, v] for u in adj[v] if dist[u] == dist[v] - 1)
        info[s] = dist, sigma
    for n in nodes:
        r, total = len(info[n][0]) - 1, sum(info[n][0].values())
        assert got[n] == pytest.approx(r / total * r / 14 if total else 0.0)
        share = sum(info[s][1][n] * info[n][1][t] / info[s][1][t]
                    for s, t in itertools.combinations(nodes, 2)
                    if n not in (s, t) and t in info[s][0] and n in info[s][0] and t in info[n][0]
                    and info[s][0][n] + info[n][0][t] == info[s][0][t])
        assert between[n] == pytest.approx(share * 2 / (14 * 13))


def test_a_hub_of_thousands(spark):
    """One hub of 4000 members beside small ones, through the same code as any other."""
    rows = [(n, "h", 0) for n in range(4000)] + [(n, "g", n // 4) for n in range(4000, 4020)] + [(0, "g", 1000)]
    graph = Graph(spark.range(4020), members=spark.createDataFrame(rows, "node bigint, kind string, hub bigint"))
    degrees = scores(centrality.degree(graph))
    assert degrees[1] == 3999 / 4019 and degrees[0] == (3999 + 4) / 4019 and degrees[4000] == 4 / 4019
    found = {r.id: r.community_id for r in community.louvain(graph).collect()}
    assert {found[n] for n in range(1, 4000)} == {found[1]} and found[4004] == 4004 == found[4007]
    assert len(found) == 4020


def test_closeness_of_named_and_by_sketches(hub_graph, graph, spark):
    for g, nodes in ((hub_graph[0], hub_graph[2]), (graph, NODES)):
        exact = scores(centrality.closeness(g))
        named = scores(centrality.closeness(g, sources=spark.createDataFrame([(nodes[1],), (nodes[2],), (999,)], "source bigint")))
        assert named == {n: pytest.approx(exact[n]) for n in nodes[1:3]}
        sketched = scores(centrality.closeness_by_sketches(g))
        assert sketched == {n: pytest.approx(exact[n]) for n in nodes}


def test_sketches_keep_their_error(spark):
    """Thousands of nodes: counts beyond what a sketch holds as it is."""
    rng = random.Random(4)
    edges = {tuple(sorted((i, rng.randrange(i)))) for i in range(1, 3000)} | {tuple(sorted(rng.sample(range(3000), 2))) for _ in range(12000)}
    g = make(spark, edges, range(3000))
    named = rng.sample(range(3000), 4)
    exact = scores(centrality.closeness(g, sources=spark.createDataFrame([(n,) for n in named], "source bigint")))
    rows = {r.id: r for r in centrality.closeness_by_sketches(g).collect()}
    assert len(rows) == 3000
    for n in named:  # the score is a quotient of a squared count and a sum of counts: four errors' room for each
        assert rows[n].reached == pytest.approx(3000, rel=4 * centrality.SKETCH_ERROR)
        assert rows[n].score == pytest.approx(exact[n], rel=12 * centrality.SKETCH_ERROR)


def test_pivots_stop_within_their_bound(spark):
    # a few hubs of a star forest carry all paths; shares of leaves are 0
    edges = [(0, i) for i in range(1, 4)] + [(1 + i % 3, 4 + i) for i in range(400)]
    g = make(spark, edges, range(404))
    exact = scores(centrality.betweenness(g))
    rows = centrality.betweenness_by_pivots(g, error=0.4, first=64).collect()
    assert len(rows) == 404 and {r.pivots for r in rows} == {64} or {r.pivots for r in rows} == {128}
    assert all(r.low - 1e-9 <= exact[r.id] <= r.high + 1e-9 and r.high - r.low <= 0.8 + 1e-9 for r in rows)
    whole = centrality.betweenness_by_pivots(g, error=0.0).collect()
    assert {r.pivots for r in whole} == {404}
    assert all(r.low == r.high == r.score == pytest.approx(exact[r.id]) for r in whole)


@pytest.mark.parametrize("hubs", [True, False])
def test_closeness_holds_no_row_per_source_and_node(spark, monkeypatch, hubs):
    """130 sources in three masks; what a level writes stays within one row per node or membership."""
    rng = random.Random(11)
    ids = [7 * i - 300 for i in range(130)]
    rows = [(n, "h", h) for h in range(60) for n in rng.sample(ids[:-1], 4)]
    pairs = sorted({tuple(sorted(p)) for h in range(60)
                    for p in itertools.combinations([r[0] for r in rows if r[2] == h], 2)})
    nodes = spark.createDataFrame([(n,) for n in ids], "id bigint")
    g = Graph(nodes, members=spark.createDataFrame(rows, "node bigint, kind string, hub bigint")) if hubs else make(spark, pairs, ids)
    sizes, write = [], centrality.cut_lineage

    def counted(df):
        out = write(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(centrality, "cut_lineage", counted)
    got = scores(centrality.closeness(g))
    assert max(sizes) <= 130
    adj = neighbours(pairs, ids)
    for n in ids:
        dist = search(adj, n)[0]
        r, total = len(dist) - 1, sum(dist.values())
        assert got[n] == pytest.approx(r / total * r / 129 if total else 0.0)


def test_betweenness_holds_no_row_per_source_and_node(spark, monkeypatch):
    """Four blocks of nodes, three of sources; what a level writes stays within a row per node and block of sources."""
    tiles = centrality.tiles
    rng = random.Random(12)
    ids = [5 * i - 200 for i in range(120)]
    pairs = sorted({tuple(sorted(rng.sample(ids[:-1], 2))) for _ in range(300)})
    sizes, write = [], centrality.cut_lineage

    def counted(df):
        out = write(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(centrality, "cut_lineage", counted)
    monkeypatch.setattr(tiles, "cut_lineage", counted)
    monkeypatch.setattr(tiles, "SIDE", 32)
    monkeypatch.setattr(tiles, "WIDTH", 48)
    monkeypatch.setattr(tiles, "STEP", 20)
    got = scores(centrality.betweenness(make(spark, pairs, ids)))
    assert max(sizes) <= 3 * 120
    adj = neighbours(pairs, ids)
    want = dict.fromkeys(ids, 0.0)
    for s in ids:  # Brandes
        dist, sigma, order = search(adj, s)
        delta = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in adj[v]:
                if dist[u] == dist[v] - 1:
                    delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
            if v != s:
                want[v] += delta[v]
    for v in ids:
        assert got[v] == pytest.approx(want[v] / (119 * 118))


def test_sketches_are_merged_in_memory(spark, monkeypatch):
    """Five parts of nodes; groups beyond Spark's 128 do not go to a sort while sketches are merged."""
    rng = random.Random(13)
    ids = list(range(200))
    g = make(spark, sorted({tuple(sorted(rng.sample(ids, 2))) for _ in range(700)}), ids)
    exact = scores(centrality.closeness(g))
    limit, held, write = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", [], centrality.cut_lineage
    before = spark.conf.get(limit)

    def noted(df):
        held.append(int(spark.conf.get(limit)))
        return write(df)

    monkeypatch.setattr(centrality, "SKETCHES_PER_TASK", 40, raising=False)
    monkeypatch.setattr(centrality, "cut_lineage", noted)
    got = scores(centrality.closeness_by_sketches(g))
    assert held[1:] and min(held[1:]) >= 160 and spark.conf.get(limit) == before
    for n in ids:
        assert got[n] == pytest.approx(exact[n])


def test_members_without_id_and_nodes_given_twice(spark):
    """A member without an id counts at each level that touches its hub; a node given twice stays twice, not four times."""
    members = spark.createDataFrame([(1, "h", 1), (2, "h", 1), (None, "h", 1), (2, "h", 2), (3, "h", 2)], "node bigint, kind string, hub bigint")
    got = scores(centrality.closeness(Graph(spark.createDataFrame([(1,), (2,), (3,)], "id bigint"), members=members)))
    # from 1: 2 and the one without id at 1, 3 and it again at 2, from hub 1 once more
    assert got[1] == pytest.approx(4 / 6 * 4 / 2)
    rows = centrality.betweenness_by_pivots(make(spark, [(1, 2), (2, 3), (1, 3)], [1, 1, 2, 3])).collect()
    assert sorted(r.id for r in rows) == [1, 1, 2, 3] and {r.score for r in rows} == {0.0}


def test_tiles_leave_only_results(spark, monkeypatch):
    """Sources go in turns when a step would send too much; the levels of finished turns are removed."""
    tiles, written = centrality.tiles, []
    rng = random.Random(21)
    ids = [3 * i - 100 for i in range(90)]
    pairs = sorted({tuple(sorted(rng.sample(ids[:-1], 2))) for _ in range(200)})
    write = tiles.cut_lineage

    def noted(df):
        out = write(df)
        written.append((out.written_to, out.columns))
        return out

    exact = scores(centrality.betweenness(make(spark, pairs, ids)))
    near = scores(centrality.closeness(make(spark, pairs, ids)))
    monkeypatch.setattr(tiles, "cut_lineage", noted)
    monkeypatch.setattr(tiles, "SIDE", 32)
    monkeypatch.setattr(tiles, "WIDTH", 16)
    monkeypatch.setattr(tiles, "BITS", 24)
    monkeypatch.setattr(tiles, "MOST_BYTES", 1)
    got = scores(centrality.betweenness(make(spark, pairs, ids)))
    assert len([1 for _, c in written if c == ["node", "s", "q"]]) == 6  # 16 of 89 at a time
    assert scores(centrality.closeness(make(spark, pairs, ids))) == pytest.approx(near)
    assert got == pytest.approx(exact)
    levels = [path for path, c in written if c == ["node", "s", "v", "a", "b"]]
    assert levels and not any(os.path.exists(path) for path in levels)
    adj = neighbours(pairs, ids)
    for n in ids:
        dist = search(adj, n)[0]
        r, total = len(dist) - 1, sum(dist.values())
        assert near[n] == pytest.approx(r / total * r / 89 if total else 0.0)


def test_packed_strips():
    tiles = centrality.tiles
    for slots in ([], [3], [0, 31], list(range(32)), [4, 4, 9], list(range(30)) + [7]):
        marks = tiles._marks(slots, 32)
        assert tiles._edges([marks, tiles._marks([1], 32)], 32, float)[:, 0].tolist() == [slots.count(i) for i in range(32)]


def test_sketches_meet_links_in_place(spark):
    """However small the links' files are, they are not gathered at the driver to be broadcast."""
    sent = bucketed(spark.createDataFrame([(1, "a"), (2, "b")], "src bigint, sketch string"), "src", buckets=4)
    links = bucketed(spark.createDataFrame([(1, 2), (2, 1)], "src bigint, dst bigint"), "src", buckets=4)
    plan = centrality._sent_along(sent, links)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text and "Exchange" not in text
    assert sorted(map(tuple, plan.collect())) == [(1, "b"), (2, "a")]


def test_louvain_in_arrays(spark, monkeypatch):
    """Rounds in arrays move the same nodes as rounds in joins, and few jobs are run for each."""
    ids = [-3, 0, 5, 1 << 40, -(1 << 62)]
    for turn in (0, 1, 77):
        want = spark.createDataFrame([(i,) for i in ids], "id bigint").select(F.xxhash64("id", F.lit(turn))).collect()
        assert community._hashed(np.array(ids), turn).tolist() == [r[0] for r in want]
    rng = random.Random(31)
    nodes = [4 * i - 50 for i in range(60)]
    pairs = sorted({tuple(sorted((x, y))) for x, y in (rng.sample(nodes, 2) for _ in range(260))
                    if (x // 80 == y // 80 or rng.random() < 0.15)})
    found, writes, write = [], [], community.cut_lineage

    def noted(df):
        writes[-1] += 1
        return write(df)

    monkeypatch.setattr(community, "cut_lineage", noted)
    for most in (1 << 18, 0):
        monkeypatch.setattr(community, "NODES_IN_ARRAYS", most, raising=False)
        writes.append(0)
        found.append({r.id: r.community_id for r in community.louvain(make(spark, pairs, nodes)).collect()})
    assert found[0] == found[1] and len(set(found[0].values())) < len(nodes)
    assert writes[0] < writes[1]  # none per round


def test_louvain_of_nodes_given_twice(spark, monkeypatch):
    """A node given twice counts as it does in the joins, whatever the size of the graph."""
    nodes, found = [*NODES, 1, 11], []
    for most in (1 << 18, 0):
        monkeypatch.setattr(community, "NODES_IN_ARRAYS", most)
        found.append(sorted(map(tuple, community.louvain(make(spark, EDGES, nodes)).collect())))
    assert found[0] == found[1] and len(found[0]) >= len(nodes)
