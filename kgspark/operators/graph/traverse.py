"""Traversals, many starts at a time: breadth first by levels, from both ends of a pair, and by cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from kgspark.operators.graph.build import Graph
from kgspark.session import bucketed, cut_lineage


def _through_hubs(frontier: DataFrame, graph: Graph, used_hubs: DataFrame | None):
    """Hubs newly touched by the frontier, each with its smallest frontier member."""
    hubs = (frontier.select("source", "node").join(graph.by_node, "node")
            .groupBy("source", "kind", "hub").agg(F.min("node").alias("parent")))
    if used_hubs is not None:
        hubs = hubs.join(used_hubs, ["source", "kind", "hub"], "left_anti")
    return cut_lineage(hubs)


def _level(found: list[DataFrame], previous: list[DataFrame], depth: int) -> DataFrame:
    """New nodes with their smallest parent. In an undirected graph a neighbour of level d
    lies in d-1, d or d+1, so only the last two levels must be excluded."""
    merged = reduce(DataFrame.unionByName, found)
    fresh = merged.join(reduce(DataFrame.unionByName, [p.select("source", "node") for p in previous]),
                        ["source", "node"], "left_anti")
    return cut_lineage(fresh.groupBy("source", "node").agg(
        F.lit(depth).alias("dist"), F.min("parent").alias("parent")))


def bfs_levels(graph: Graph, sources: DataFrame, max_depth: int | None = None,
               targets: DataFrame | None = None) -> list[DataFrame]:
    """Levels of a multi-source search: (source, node, dist, parent).

    ``sources`` has column source; ``targets`` (source, target) stops the search as soon
    as every target is reached. A hub is expanded once per source, so each membership
    row is read at most twice per source.
    """
    start = sources.distinct().join(graph.nodes.select(F.col("id").alias("source")), "source", "left_semi")
    levels = [cut_lineage(start.select("source", F.col("source").alias("node"), F.lit(0).alias("dist"),
                                       F.lit(None).cast("bigint").alias("parent")))]
    hubs, open_targets, depth = None, targets, 0
    while max_depth is None or depth < max_depth:
        frontier = levels[-1]
        if open_targets is not None:
            open_targets = open_targets.join(
                frontier.select("source", F.col("node").alias("target")), ["source", "target"], "left_anti")
            if open_targets.isEmpty():
                break
        depth += 1
        found = []
        if graph.pairs is not None:
            found.append(frontier.select("source", F.col("node").alias("src")).join(graph.links, "src").select(
                "source", F.col("dst").alias("node"), F.col("src").alias("parent")))
        if graph.members is not None:
            # hubs of the level before last cannot touch the frontier again
            hubs = _through_hubs(frontier, graph, hubs)
            found.append(hubs.join(graph.by_hub, ["kind", "hub"]).select("source", "node", "parent"))
        level = _level(found, levels[-2:], depth)
        if level.isEmpty():
            break
        levels.append(level)
    return levels


def distances(levels: list[DataFrame]) -> DataFrame:
    return all_levels(levels).select("source", "node", "dist")


def all_levels(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def with_hubs(steps: DataFrame, graph: Graph) -> DataFrame:
    """Add kind and via, the smallest hub that a step's parent and node share; looked up
    for the given steps only, so that searches need not carry hubs along."""
    none = {"kind": F.lit(None).cast("string"), "via": F.lit(None).cast("bigint")}
    if graph.members is None:
        return steps.withColumns(none)
    of_node = steps.select("parent", "node").where("parent IS NOT NULL").distinct().join(graph.by_node, "node")
    shared = of_node.join(graph.by_node.withColumnRenamed("node", "parent"), ["parent", "kind", "hub"])
    first = shared.groupBy("parent", "node").agg(F.min(F.struct("kind", "hub")).alias("h")).select(
        "parent", "node", "h.kind", F.col("h.hub").alias("via"))
    return steps.join(first, ["parent", "node"], "left")


def walk_back(levels: list[DataFrame], pairs: DataFrame) -> DataFrame:
    """Paths for reached (source, target) pairs: dist and path, the node ids from the source on."""
    ends = pairs.join(distances(levels).withColumnRenamed("node", "target"), ["source", "target"])
    paths = ends.select("source", "target", "dist", F.col("target").alias("node"),
                        F.array("target").alias("path"))
    for level in reversed(levels[1:]):
        joined = paths.join(level.select("source", "node", "parent"), ["source", "node"], "left")
        paths = joined.select(
            "source", "target", "dist", F.coalesce("parent", "node").alias("node"),
            F.when(F.col("parent").isNotNull(), F.concat(F.array("parent"), F.col("path")))
            .otherwise(F.col("path")).alias("path"))
    return paths.select("source", "target", "dist", "path")


def name_steps(paths: DataFrame, graph: Graph) -> DataFrame:
    """Add steps, the path as (node, kind, via) with the hub entered to reach each node.
    Rows are collected per path, so no longer than the path itself."""
    hops = paths.select("source", "target", "path", F.posexplode("path").alias("pos", "node")).select(
        "source", "target", "pos", "node", F.when(F.col("pos") > 0, F.col("path")[F.col("pos") - 1]).alias("parent"))
    steps = with_hubs(hops, graph).groupBy("source", "target").agg(
        F.array_sort(F.collect_list(F.struct("pos", "node", "kind", "via"))).alias("steps"))
    return paths.join(steps, ["source", "target"], "left")


SIDE = ["pair", "side"]


def _expand(front: DataFrame, graph: Graph, keys: list[str], used: DataFrame | None, effort: list | None) -> tuple[DataFrame, DataFrame | None]:
    """(keys, node, parent) next to rows (keys, node), with repeats, and the hubs gone through, but for ``used`` ones."""
    found, hubs = [], None
    if graph.pairs is not None:
        found.append(front.select(*keys, F.col("node").alias("src")).join(graph.links, "src").select(
            *keys, F.col("dst").alias("node"), F.col("src").alias("parent")))
    if graph.members is not None:
        hubs = (front.select(*keys, "node").join(graph.by_node, "node")
                .groupBy(*keys, "kind", "hub").agg(F.min("node").alias("parent")))
        if used is not None:
            hubs = hubs.join(used, [*keys, "kind", "hub"], "left_anti")
        hubs = cut_lineage(hubs)
        found.append(hubs.join(graph.by_hub, ["kind", "hub"]).select(*keys, "node", "parent"))
    if effort is not None:
        effort += [front.join(graph.by_node, "node").count() if hubs is not None else 0, found[-1].count()]
    return reduce(DataFrame.unionByName, found), hubs


def _kept(new: DataFrame, old: DataFrame | None, grown: DataFrame) -> DataFrame:
    """What the grown sides found now, and what the others have from before."""
    return new if old is None else new.unionByName(old.join(grown, SIDE, "left_anti").select(new.columns))


def meet_in_the_middle(graph: Graph, pairs: DataFrame, max_depth: int | None = None,
                       effort: list | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Searches from both ends of each row (pair, source, target).

    Returns (pair, dist, side 0's depth, side 1's depth, node) for every node where the two searches of a
    pair met, and all levels (pair, side, node, parent, dist). In each round the end with fewer newest nodes
    grows by one level. While the two have not met, no path is as short as their depths together; so the
    first meeting, which joins the newest levels only, is at the least distance. ``effort`` collects the rows
    of the graph that were touched.
    """
    ends = F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("source").alias("node")),
                            F.struct(F.lit(1).alias("side"), F.col("target").alias("node"))))
    front = cut_lineage(pairs.select("pair", ends).select(*SIDE, "node", F.lit(None).cast("bigint").alias("parent"), F.lit(0).alias("dist")))
    levels, met, before, hubs = [front], [], None, None
    while True:
        one, two = (front.where(F.col("side") == k) for k in (0, 1))
        here = cut_lineage(one.select("pair", "node", F.col("dist").alias("ahead")).join(
            two.select("pair", "node", F.col("dist").alias("back")), ["pair", "node"]))
        met.append(here)
        depth = front.groupBy(*SIDE).agg(F.count("*").alias("size"), F.max("dist").alias("dist"))
        deep = depth.groupBy("pair").agg(F.count("*").alias("sides"), F.sum("dist").alias("depth"),
                                         F.min_by("side", F.struct("size", "side")).alias("side"))
        grown = deep.where("sides = 2" + ("" if max_depth is None else f" AND depth < {max_depth}")).join(
            here.select("pair").distinct(), "pair", "left_anti").select(*SIDE)
        grown = cut_lineage(grown)
        if grown.isEmpty():
            return reduce(DataFrame.unionByName, met).select(
                "pair", (F.col("ahead") + F.col("back")).alias("dist"), "ahead", "back", "node"), levels
        growing = cut_lineage(front.join(grown, SIDE, "left_semi"))
        reached, now = _expand(growing, graph, SIDE, hubs, effort)
        known = growing.select(*SIDE, "node")
        if before is not None:  # a neighbour of the newest level lies in it, before it or after it
            known = known.unionByName(before.select(*SIDE, "node"))
        at = growing.groupBy(*SIDE).agg((F.max("dist") + 1).alias("dist"))
        level = cut_lineage(reached.join(known, [*SIDE, "node"], "left_anti").groupBy(*SIDE, "node")
                            .agg(F.min("parent").alias("parent")).join(at, SIDE))
        levels.append(level)
        # pairs that are still open go on, each side with its newest level
        going = grown.select("pair").distinct()
        before = cut_lineage(_kept(growing, before, grown))
        hubs = None if now is None else cut_lineage(_kept(now, hubs, grown))
        front = cut_lineage(_kept(level, front, grown).join(going, "pair", "left_semi"))


def shortest_paths(graph: Graph, pairs: DataFrame, max_depth: int | None = None,
                   name_hubs: bool = False, effort: list | None = None) -> DataFrame:
    """One row per (source, target): status OK, NO_PATH or UNKNOWN_NODE, distance and path,
    and on request steps with the hubs. Among equal paths the smallest parent at every
    step counted from the target wins. Searched from both ends."""
    pairs = cut_lineage(pairs.select("source", "target").distinct().withColumn("pair", F.monotonically_increasing_id()))
    ids = graph.nodes.select("id")
    valid = cut_lineage(pairs.join(ids, F.col("target") == F.col("id"), "left_semi")
                        .join(ids, F.col("source") == F.col("id"), "left_semi"))
    met, levels = meet_in_the_middle(graph, valid, max_depth, effort)
    met = cut_lineage(met)
    every = reduce(DataFrame.unionByName, levels)
    ahead = every.where("side = 0").select("pair", "node", "dist", "parent")
    behind = every.where("side = 1").select("pair", "node", F.col("dist").alias("back"))
    # from the meeting on towards the target, along nodes of shortest paths only
    step, upper = met.select("pair", "node", "dist", "back"), []
    while True:
        last = step.where("back = 1")
        upper.append(last.groupBy("pair", "dist").agg(F.min("node").alias("parent"))
                     .join(valid.select("pair", F.col("target").alias("node")), "pair").select("pair", "node", "dist", "parent"))
        longer = step.where("back > 1")
        if longer.isEmpty():
            break
        reached, _ = _expand(longer, graph, ["pair", "dist", "back"], None, effort)
        nearer = reached.withColumn("back", F.col("back") - 1).join(behind, ["pair", "node", "back"], "left_semi")
        step = cut_lineage(nearer.groupBy("pair", "node", "dist", "back").agg(F.min("parent").alias("parent")))
        upper.append(step.select("pair", "node", (F.col("dist") - F.col("back")).alias("dist"), "parent"))
    parents = cut_lineage(reduce(DataFrame.unionByName, [ahead.where("dist > 0"), *upper]))
    found = _walk(valid.join(met.select("pair", "dist").distinct(), "pair"), parents)
    if name_hubs:
        found = name_steps(found, graph)
    return (pairs.drop("pair").join(valid.select("source", "target", F.lit(True).alias("known")), ["source", "target"], "left")
            .join(found, ["source", "target"], "left")
            .withColumn("status", F.when(F.col("known").isNull(), "UNKNOWN_NODE")
                        .when(F.col("dist").isNull(), "NO_PATH").otherwise("OK"))
            .withColumnRenamed("dist", "distance").drop("known"))


def _walk(found: DataFrame, parents: DataFrame) -> DataFrame:
    """(source, target, dist, path) of rows (pair, source, target, dist), back from the target one parent at a time."""
    paths = cut_lineage(found.select("pair", "source", "target", "dist", F.col("target").alias("node"), F.col("dist").alias("at"),
                                     F.array("target").alias("path")))
    deepest = paths.agg(F.max("dist")).first()[0] or 0
    for at in range(deepest, 0, -1):
        here = parents.where(F.col("dist") == at).select("pair", "node", "parent")
        paths = paths.join(here, ["pair", "node"], "left").select(
            "pair", "source", "target", "dist", F.when(F.col("at") == at, F.col("parent")).otherwise(F.col("node")).alias("node"),
            F.when(F.col("at") == at, F.col("at") - 1).otherwise(F.col("at")).alias("at"),
            F.when(F.col("at") == at, F.concat(F.array("parent"), F.col("path"))).otherwise(F.col("path")).alias("path"))
    return paths.select("source", "target", "dist", "path")


def weighted_distances(graph: Graph, weights: DataFrame | None, sources: DataFrame, hub_weights: DataFrame | None = None,
                       width: float | None = None) -> DataFrame:
    """Least total weight per (source, node); ``weights`` has a, b, w and ``hub_weights`` kind, hub, w, with w >= 0:
    going from one member of a hub to another costs the hub's weight.

    Costs are settled in order, a bucket of ``width`` at a time (by default the mean weight): nodes of the
    lowest bucket are expanded over weights below the width until none of the bucket improves any more, then
    once over the others. Costs beyond the bucket wait.
    """
    edges = []
    if weights is not None:
        both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"),
                                 F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w")))
        links = bucketed(weights.select(both.alias("e")).select("e.*"), "src")
        edges.append(links)
    if hub_weights is not None:
        entry = bucketed(graph.by_node.join(hub_weights, ["kind", "hub"]), "node")
        edges.append(entry)
    if width is None:
        width = reduce(DataFrame.unionByName, [e.select(F.col("w").cast("double").alias("w")) for e in edges]).agg(F.avg("w")).first()[0] or 1.0

    def offers(front: DataFrame, which: str) -> DataFrame:
        """(source, node, offer) over light or heavy weights."""
        found = []
        if weights is not None:
            found.append(front.withColumnRenamed("node", "src").join(links.where(which), "src").select(
                "source", F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("offer")))
        if hub_weights is not None:
            into = (front.join(entry.where(which), "node").groupBy("source", "kind", "hub")
                    .agg(F.min(F.col("cost") + F.col("w")).alias("offer")))
            found.append(into.join(graph.by_hub, ["kind", "hub"]).select("source", "node", "offer"))
        return reduce(DataFrame.unionByName, found).groupBy("source", "node").agg(F.min("offer").alias("offer"))

    def improved(state: DataFrame, expanded: str, offered: DataFrame, heavy_next: bool) -> DataFrame:
        """The state after offers: ``expanded`` rows are no longer fresh, better ones are."""
        done = F.expr(expanded)
        old = state.select("source", "node", "cost", (F.col("fresh") & ~done).alias("fresh"),
                           (F.col("due") | done if heavy_next else F.lit(False)).alias("due"))
        better = F.col("offer").isNotNull() & (F.col("cost").isNull() | (F.col("offer") < F.col("cost")))
        return cut_lineage(old.join(offered, ["source", "node"], "full").select(
            "source", "node", F.least("cost", "offer").alias("cost"), (F.coalesce("fresh", F.lit(False)) | better).alias("fresh"),
            (F.coalesce("due", F.lit(False)) & ~better).alias("due")))

    state = cut_lineage(sources.distinct().join(graph.nodes.select(F.col("id").alias("source")), "source", "left_semi").select(
        "source", F.col("source").alias("node"), F.lit(0).cast("double").alias("cost"), F.lit(True).alias("fresh"), F.lit(False).alias("due")))
    while True:
        low = state.where("fresh").agg(F.min("cost")).first()[0]
        if low is None:
            return state.select("source", "node", "cost")
        top = (low // width + 1) * width
        while top <= low:  # rounding
            top += width
        mine = f"fresh AND cost < {top!r}"
        while not (front := state.where(mine)).isEmpty():
            state = improved(state, mine, offers(front.select("source", "node", "cost"), f"w < {width!r}"), True)
        heavy = offers(state.where("due").select("source", "node", "cost"), f"w >= {width!r}")
        state = improved(state, "false", heavy, False)
