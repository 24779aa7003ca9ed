"""Centralities of undirected graphs. A pair edge weighs 1, a hub edge as many as the hubs shared:
degree adds these weights, and paths over different hubs are different shortest paths.

Definitions: degree and closeness after Freeman with the usual correction for several
components, betweenness after Brandes (2001), eigenvector after Bonacich (1972).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from kgspark.operators.graph import tiles
from kgspark.operators.graph.build import Graph, Neighbours
from kgspark.session import bucketed, cut_lineage, setting

# fixed values: iteration cap and tolerance of the power iteration
MAX_STEPS = 100
TOLERANCE = 1e-6
SOURCES_PER_BATCH = 4096


def degree(graph: Graph) -> DataFrame:
    """Weighted degree / (n - 1); isolated nodes score 0."""
    n = graph.nodes.agg(F.count("*")).scalar()
    ones = graph.nodes.select(F.col("id").alias("node"), F.lit(1).cast("bigint").alias("v"))
    counted = Neighbours(graph).total(ones).select(F.col("node").alias("id"), "v")
    return graph.nodes.select("id").join(counted, "id", "left").select(
        "id", F.coalesce(F.col("v") / (n - 1), F.lit(0.0)).alias("score"))


def _batches(graph: Graph, per_batch: int):
    """Sources in hash batches, so that a batch's (source, node) state stays bounded."""
    total = graph.nodes.count()
    parts = max(1, math.ceil(total / per_batch))
    nodes = graph.nodes.select(F.col("id").alias("source"))
    for i in range(parts):
        yield nodes.where(F.pmod(F.xxhash64("source"), F.lit(parts)) == i)


def _sigma_levels(sources: DataFrame, around: Neighbours) -> list[DataFrame]:
    """Levels (source, node, sigma) with sigma the number of shortest paths from the source."""
    levels = [cut_lineage(sources.select("source", F.col("source").alias("node"),
                                         F.lit(1.0).alias("sigma")))]
    while True:
        seen = reduce(DataFrame.unionByName, [x.select("source", "node") for x in levels[-2:]])
        values = levels[-1].withColumnRenamed("sigma", "v")
        nxt = around.total(values, ("source",)).join(seen, ["source", "node"], "left_anti")
        nxt = cut_lineage(nxt.withColumnRenamed("v", "sigma"))
        if nxt.isEmpty():
            return levels
        levels.append(nxt)


WORD = 64  # sources in one mask
MOST_WORDS = 16  # masks in one row


def _numbered(ids: DataFrame) -> DataFrame:
    """ids: id, distinct -> (id, number), numbered from 0 in order of id. Only one count per partition is gathered."""
    at = F.monotonically_increasing_id()
    rows = cut_lineage(ids.orderBy("id").select("id", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("at")))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("start"))
    return cut_lineage(rows.join(starts, "part").select("id", (F.col("start") + F.col("at")).alias("number")))


def _fresh(heard: DataFrame, known: list[DataFrame], keys: list[str], masks: list[str]) -> DataFrame:
    """The bits of ``heard`` that stand in none of ``known``; rows without any go."""
    for i, frame in enumerate(known):
        heard = heard.join(frame.select(*keys, *(F.col(m).alias(f"{m}_{i}") for m in masks)), keys, "left")
    left = [reduce(lambda x, i: x.bitwiseAND(F.bitwise_not(F.coalesce(F.col(f"{m}_{i}"), F.lit(0).cast("bigint")))), range(len(known)), F.col(m)).alias(m)
            for m in masks]
    return heard.select(*keys, *left).where(reduce(lambda x, y: x | y, (F.col(m) != 0 for m in masks)))


def _distance_counts(graph: Graph, sources: DataFrame) -> DataFrame | None:
    """sources: source, distinct -> (source, r, d): nodes reached and the sum of their distances, none if no source has neighbours.

    A row stands for a node and up to 1024 sources, one bit each: edges are followed for all of them at once, and
    what meets at a hub or node is one OR. A neighbour of level d lies in d - 1, d or d + 1 and a hub is touched
    from at most two levels in turn, so only the last two levels of nodes and the last one of hubs are looked back at.
    """
    numbers = _numbered(sources.select(F.col("source").alias("id")))
    total = numbers.count()
    if not total:
        return None
    words = min(MOST_WORDS, -(-total // WORD))
    masks = [f"m{w}" for w in range(words)]
    word, bit = F.floor(F.col("number") / WORD), F.expr(f"shiftleft(1L, CAST(number % {WORD} AS INT))")
    ors = [F.bit_or(m).alias(m) for m in masks]
    first = numbers.select(F.col("id").alias("node"), F.floor(word / words).alias("block"),
                           *(F.when(word % words == w, bit).otherwise(F.lit(0).cast("bigint")).alias(m) for w, m in enumerate(masks)))
    levels, touched, counts = [cut_lineage(first)], None, []
    while True:
        passed = []
        if graph.pairs is not None:
            passed.append(levels[-1].withColumnRenamed("node", "src").join(graph.links, "src").select("block", F.col("dst").alias("node"), *masks))
        if graph.members is not None:
            keys = ["block", "kind", "hub"]
            hubs = cut_lineage(levels[-1].join(graph.by_node, "node").groupBy(*keys).agg(*ors))
            first_time = _fresh(hubs, [touched] if touched is not None else [], keys, masks)
            passed.append(first_time.join(graph.by_hub.where("node IS NOT NULL"), ["kind", "hub"]).select("block", "node", *masks))
            # a member without an id is never known: it counts at every level that touches its hub
            passed.append(hubs.join(graph.by_hub.where("node IS NULL"), ["kind", "hub"]).select("block", "node", *masks))
            touched = hubs
        heard = reduce(DataFrame.unionByName, passed).groupBy("block", "node").agg(*ors)
        level = cut_lineage(_fresh(heard, levels[-2:], ["block", "node"], masks))
        if level.isEmpty():
            break
        levels.append(level)
        cells = level.select("block", F.posexplode(F.array(*masks)).alias("w", "mask")).where("mask <> 0").select(
            (F.col("block") * words + F.col("w")).alias("word"), "mask", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("bit"))
        counts.append(cells.where("shiftright(mask, bit) & 1 = 1").groupBy((F.col("word") * WORD + F.col("bit")).alias("number")).agg(
            F.count("*").alias("r"), (F.count("*") * (len(levels) - 1)).alias("d")))
    if not counts:
        return None
    return cut_lineage(reduce(DataFrame.unionByName, counts).groupBy("number").agg(F.sum("r").alias("r"), F.sum("d").alias("d"))
                       .join(numbers, "number").select(F.col("id").alias("source"), "r", "d"))


def _closeness_sums(graph: Graph, per_batch: int, sources: DataFrame | None) -> list[DataFrame]:
    """(source, r, d) of each batch of sources that reach anything."""
    sums = []
    for batch in [sources] if sources is not None else _batches(graph, per_batch):
        found = _distance_counts(graph, batch.where("source IS NOT NULL").distinct())
        if found is not None:
            sums.append(found)
    return sums


def closeness(graph: Graph, per_batch: int = SOURCES_PER_BATCH, sources: DataFrame | None = None) -> DataFrame:
    """(r-1)/sum(d) * (r-1)/(n-1) with r the reachable nodes including the node itself, exactly.

    Each level of a batch adds its counts per source; only two levels are looked back at. Of all nodes that
    is a bit per source and node, on pair edges in tiles; ``sources`` (source) names the nodes to score,
    ``closeness_by_sketches`` scores all.
    """
    sums = []
    if graph.members is None and graph.pairs is not None:
        wanted = _in_strips(graph, sources if sources is not None else graph.nodes.select(F.col("id").alias("source")))
        for some in tiles.turns(graph.strips, wanted, per_batch, bits=True):
            found = tiles.distance_counts(graph.strips, graph.linked, some)
            if found is not None:
                sums.append(found)
    else:
        sums = _closeness_sums(graph, per_batch, sources)
    n = graph.nodes.agg(F.count("*")).scalar()
    nodes = graph.nodes.select("id")
    if sources is not None:
        nodes = nodes.join(sources.select(F.col("source").alias("id")).distinct(), "id", "left_semi")
    if not sums:
        return nodes.withColumn("score", F.lit(0.0))
    total = reduce(DataFrame.unionByName, sums).withColumnRenamed("source", "id")
    r, d = F.col("r").cast("double"), F.col("d")
    return nodes.join(total, "id", "left").select(
        "id", F.coalesce((r / d) * (r / (n - 1)), F.lit(0.0)).alias("score"))


SKETCH = 12  # log2 of a sketch's registers
SKETCH_ERROR = 1.04 / math.sqrt(1 << SKETCH)  # standard error of a count; sets of a few hundred are counted as they are


SKETCH_BUCKETS = 16  # buckets of sources: a node's sketches meet in so many partial ones at most
SKETCHES_PER_TASK = 4096  # nodes whose sketches a task holds open at a time
FALLBACK = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


def _sketches_in_memory(spark):
    """Aggregates of sketches hold a few thousand groups: at Spark's 128 they would sort one whole sketch per edge on disk."""
    return setting(spark, FALLBACK, str(4 * SKETCHES_PER_TASK))


def _sent_along(sent: DataFrame, part: DataFrame) -> DataFrame:
    """Sketches (src, sketch) at the ends of links (src, dst), both in buckets of src.

    Merged where they lie: a part's links pack to a few MB of files, for which Spark would gather millions of them at the driver.
    """
    return sent.hint("merge").join(part, "src").select(F.col("dst").alias("node"), "sketch")


def closeness_by_sketches(graph: Graph, lg: int = SKETCH) -> DataFrame:
    """(id, score, reached): closeness of all nodes with one row per node.

    Every node holds a distinct-count sketch of the nodes within d steps. A step hands sketches on along
    pair edges and through hubs, where they merge, until no count grows. A node's distances sum up from the
    growth of its counts. Along pair edges a task merges what one bucket of sources sends to one part of the
    nodes, so a sketch per bucket and node is moved, not one per edge. A count has a relative standard error of 1.04 / sqrt(2^lg); ``reached`` is the last.
    """
    if graph.nodes.isEmpty():
        return graph.nodes.select("id", F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("reached"))
    sketch, union = f"hll_sketch_agg(node, {lg})", "hll_union_agg(sketch)"
    size = F.round(F.expr("hll_sketch_estimate(sketch)")).cast("bigint")
    none = F.lit(0).cast("bigint")
    state = cut_lineage(graph.nodes.select(F.col("id").alias("node")).groupBy("node").agg(F.expr(sketch).alias("sketch"))
                        .select("node", "sketch", F.lit(1).cast("bigint").alias("n"), none.alias("far"), F.lit(True).alias("grew")))
    if graph.pairs is not None:
        parts = -(-state.count() // SKETCHES_PER_TASK)
        dealt = graph.adjacency().withColumn("part", F.pmod(F.xxhash64("dst"), F.lit(parts)))
        dealt = bucketed(dealt, "src", buckets=SKETCH_BUCKETS, folder="part")
        links = [dealt.where(F.col("part") == i).select("src", "dst") for i in range(parts)]
    depth = 0
    while not state.where("grew").isEmpty():
        depth += 1
        passed = [state.select("node", "sketch")]
        if graph.pairs is not None:  # a task holds the links from one bucket of sources to one part of the nodes
            sent = bucketed(state.select(F.col("node").alias("src"), "sketch"), "src", buckets=SKETCH_BUCKETS)
            passed += [_sent_along(sent, part) for part in links]
        if graph.members is not None:
            merged = state.join(graph.by_node, "node").groupBy("kind", "hub").agg(F.expr(union).alias("sketch"))
            passed.append(merged.join(graph.by_hub, ["kind", "hub"]).select("node", "sketch"))
        heard = reduce(DataFrame.unionByName, passed).groupBy("node").agg(F.expr(union).alias("sketch")).withColumn("now", size)
        with _sketches_in_memory(graph.nodes.sparkSession):
            state = cut_lineage(heard.join(state.select("node", "n", "far"), "node").select(
                "node", "sketch", F.greatest("now", "n").alias("n"),
                (F.col("far") + F.greatest(F.col("now") - F.col("n"), none) * depth).alias("far"), (F.col("now") > F.col("n")).alias("grew")))
    n = graph.nodes.agg(F.count("*")).scalar()
    r = (F.col("n") - 1).cast("double")
    return state.select(F.col("node").alias("id"), F.when(F.col("far") > 0, (r / F.col("far")) * (r / (n - 1))).otherwise(0.0).alias("score"),
                        F.col("n").alias("reached"))


def _dependencies(sources: DataFrame, around: Neighbours) -> DataFrame | None:
    """(source, node, delta): the share of shortest paths from each source that pass each node, none for one-level searches."""
    levels = _sigma_levels(sources, around)
    delta = levels[-1].select("source", "node", "sigma", F.lit(0.0).alias("delta"))
    gathered = []
    for depth in range(len(levels) - 1, 0, -1):
        gathered.append(delta.select("source", "node", "delta"))
        if depth == 1:
            break
        # each child passes (1 + delta) / sigma to its parents one level up
        share = ((1 + F.col("delta")) / F.col("sigma")).alias("v")
        offers = around.total(delta.select("source", "node", share), ("source",)).withColumnRenamed("v", "c")
        delta = cut_lineage(levels[depth - 1].join(offers, ["source", "node"], "left").select(
            "source", "node", "sigma", F.coalesce(F.col("sigma") * F.col("c"), F.lit(0.0)).alias("delta")))
    return reduce(DataFrame.unionByName, gathered) if gathered else None


def _dependency_sums(graph: Graph, around: Neighbours, sources: DataFrame, most: int = SOURCES_PER_BATCH) -> DataFrame | None:
    """(node, s, q): the dependencies of the sources on each node and their squares, summed; through hubs in rows, else in tiles."""
    if graph.members is not None or graph.pairs is None:
        found = _dependencies(sources, around)
        return None if found is None else cut_lineage(found.where("node <> source").groupBy("node").agg(
            F.sum("delta").alias("s"), F.sum(F.col("delta") * F.col("delta")).alias("q")))
    wanted = _in_strips(graph, sources)
    found = [x for x in (tiles.dependency_sums(graph.strips, graph.linked, some) for some in tiles.turns(graph.strips, wanted, most)) if x is not None]
    if len(found) < 2:
        return found[0] if found else None
    return cut_lineage(reduce(DataFrame.unionByName, found).groupBy("node").agg(F.sum("s").alias("s"), F.sum("q").alias("q")))


def _in_strips(graph: Graph, sources: DataFrame) -> DataFrame:
    """The sources (source, number), once the graph's nodes with neighbours are numbered and lie in strips."""
    if "strips" not in graph.__dict__:
        graph.linked = _numbered(graph.links.select(F.col("src").alias("id")).where("id IS NOT NULL").distinct())
        graph.strips = tiles.strips(graph.links, graph.linked)
    return _numbered(sources.select(F.col("source").alias("id")).where("id IS NOT NULL").distinct()).withColumnRenamed("id", "source")


def betweenness_by_pivots(graph: Graph, error: float = 0.01, risk: float = 0.05, first: int = 64, seed: int = 0) -> DataFrame:
    """(id, score, low, high, pivots): betweenness from a sample of sources, all nodes' bounds holding at once
    with probability 1 - ``risk``.

    A source's share of paths through a node, over n - 2, lies in [0, 1], and its mean over all sources is the
    score, so the mean over a random sample is unbiased. The sample doubles, from ``first`` sources on, until
    empirical Bernstein bounds (Maurer and Pontil 2009), spread over all nodes and rounds, are within ``error``
    of every score, or no source is left: then scores are exact. The order of sources is that of a hash.
    """
    n = graph.nodes.count()
    nodes = graph.nodes.select("id")
    if n < 3:
        return nodes.select("id", *(F.lit(0.0).alias(c) for c in ("score", "low", "high")), F.lit(n).cast("bigint").alias("pivots"))
    around = Neighbours(graph)
    place = F.xxhash64("id", F.lit(seed))
    sums, taken, turn = [], 0, 0
    edge = None  # hash up to which sources have been taken
    while True:
        turn += 1
        want = min(n, first << (turn - 1))
        rest = nodes.select(F.col("id").alias("source"), place.alias("place"))
        rest = rest if edge is None else rest.where(F.col("place") > edge)
        batch = cut_lineage(rest.orderBy("place", "source").limit(want - taken))  # so many sources at a time
        edge = batch.agg(F.max("place")).first()[0]
        batch = cut_lineage(rest.where(F.col("place") <= edge).select("source"))
        taken += batch.count()
        found = _dependency_sums(graph, around, batch)
        if found is not None:
            sums.append(found.select("node", (F.col("s") / (n - 2)).alias("s"), (F.col("q") / (n - 2) / (n - 2)).alias("q")))
        k, whole = float(taken), taken >= n
        total = (reduce(DataFrame.unionByName, sums).groupBy(F.col("node").alias("id")).agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
                 if sums else nodes.select("id", F.lit(0.0).alias("s"), F.lit(0.0).alias("q")))
        mean = F.col("s") / k
        # a source is no middle of its own paths: the mean over the other n - 1 sources
        scale = n / (n - 1)
        log = math.log(3 * n * turn * (turn + 1) / risk)
        spread = F.greatest((F.col("q") - k * mean * mean) / max(k - 1, 1), F.lit(0.0))
        half = F.lit(0.0) if whole else (F.sqrt(2 * spread * log / k) + 7 * log / (3 * max(k - 1, 1))) * scale
        rows = cut_lineage(nodes.join(total, "id", "left").select(
            "id", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("q", F.lit(0.0)).alias("q"))
            .select("id", (mean * scale).alias("score"), half.alias("half")))
        if whole or rows.agg(F.max("half")).first()[0] <= error:
            return rows.select("id", "score", F.greatest(F.col("score") - F.col("half"), F.lit(0.0)).alias("low"),
                               F.least(F.col("score") + F.col("half"), F.lit(1.0)).alias("high"), F.lit(taken).cast("bigint").alias("pivots"))


def betweenness(graph: Graph, per_batch: int = SOURCES_PER_BATCH) -> DataFrame:
    """Share of shortest paths through each node, scaled by 2/((n-1)(n-2))."""
    around = Neighbours(graph)
    parts = []
    in_tiles = graph.members is None and graph.pairs is not None  # they take their sources in turns
    for sources in [graph.nodes.select(F.col("id").alias("source"))] if in_tiles else _batches(graph, per_batch):
        found = _dependency_sums(graph, around, sources, per_batch)
        if found is not None:
            parts.append(found.select("node", F.col("s").alias("delta")))
    nodes = graph.nodes.select("id")
    if not parts:
        return nodes.withColumn("score", F.lit(0.0))
    n = graph.nodes.agg(F.count("*")).scalar()
    total = reduce(DataFrame.unionByName, parts).groupBy(F.col("node").alias("id")).agg(
        F.sum("delta").alias("delta"))
    # each unordered pair was counted from both ends: half of it times 2/((n-1)(n-2))
    scale = F.when(n > 2, 1.0 / ((n - 1) * (n - 2))).otherwise(0.0)
    return nodes.join(total, "id", "left").select(
        "id", F.coalesce(F.col("delta") * scale, F.lit(0.0)).alias("score"))


def eigenvector(graph: Graph, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """Power iteration on A + I with unit 2-norm; raises when it does not settle.

    Only two scalars per step reach the driver.
    """
    around = Neighbours(graph)
    n = graph.nodes.count()
    if n == 0:
        return graph.nodes.select("id").withColumn("score", F.lit(0.0))
    state = cut_lineage(graph.nodes.select("id", F.lit(1.0 / n).alias("score")))
    for _ in range(max_steps):
        passed = around.total(state.select(F.col("id").alias("node"), F.col("score").alias("v"))).select(
            F.col("node").alias("id"), F.lit(0.0).alias("prev"), F.col("v").alias("add"))
        own = state.select("id", F.col("score").alias("prev"), F.col("score").alias("add"))
        raw = cut_lineage(own.unionByName(passed).groupBy("id").agg(
            F.sum("prev").alias("prev"), F.sum("add").alias("raw")))
        norm = math.sqrt(raw.agg(F.sum(F.col("raw") * F.col("raw"))).first()[0]) or 1.0
        state = raw.select("id", (F.col("raw") / norm).alias("score"))
        change = raw.agg(F.sum(F.abs(F.col("raw") / norm - F.col("prev")))).first()[0]
        if change < n * tolerance:
            return state
    raise RuntimeError(f"power iteration did not settle in {max_steps} steps")


METHODS = {"degree": degree, "closeness": closeness, "betweenness": betweenness,
           "eigenvector": eigenvector}


def top_central(graph: Graph, method: str, top_n: int = 10) -> DataFrame:
    """The highest scores; ties go to the smaller id."""
    if method not in METHODS:
        raise ValueError(f"unknown centrality {method}")
    return METHODS[method](graph).orderBy(F.desc("score"), "id").limit(top_n)
