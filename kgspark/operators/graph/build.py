"""Undirected graphs: pair edges, and hubs standing for everyone who shares them.

Entities sharing a hub (parts on one order, suppliers of one part) are all neighbours of
each other, once per shared hub: the weight of a hub edge is the number of shared hubs. A
hub with n members stands for n(n-1)/2 neighbour pairs but is only ever kept, read and
shuffled as its n membership rows, whatever its size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, functions as F

from kgspark.session import bucketed


@dataclass
class Graph:
    """nodes: id. pairs: a, b with a < b. members: node, kind, hub. Pairs and hubs add up.

    For loops the graph is written once in buckets: memberships by node and by hub, pair edges by source.
    Steps join these tables on their bucket keys, so that only frontiers and scores are ever moved.
    """

    nodes: DataFrame
    pairs: DataFrame | None = None
    members: DataFrame | None = None

    def adjacency(self) -> DataFrame:
        """Pair edges in both directions as (src, dst)."""
        if self.pairs is None:
            raise ValueError("this graph has no pair edges")
        both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                                 F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
        return self.pairs.select(both.alias("e")).select("e.*")

    @cached_property
    def links(self) -> DataFrame:
        """The pair edges (src, dst) in buckets of src."""
        return bucketed(self.adjacency(), "src")

    @cached_property
    def by_node(self) -> DataFrame:
        """The memberships in buckets of the node."""
        return bucketed(self.members.select("node", "kind", "hub"), "node")

    @cached_property
    def by_hub(self) -> DataFrame:
        """The memberships in buckets of the hub."""
        return bucketed(self.by_node, "kind", "hub")

    @cached_property
    def held(self) -> DataFrame:
        """(node, hubs): how many hubs each node holds, in buckets of the node."""
        return bucketed(self.by_node.groupBy("node").agg(F.count("*").alias("hubs")), "node")


class Neighbours:
    """Weighted sums over neighbours, the one step all centralities are made of."""

    def __init__(self, graph: Graph):
        self.graph = graph

    def total(self, values: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
        """values: keys, node, v -> keys, node, v summed over each node's neighbours.

        Through hubs: members send their value in, the hub sends the sum back, and each
        member takes off its own share, once per hub it holds.
        """
        parts, graph = [], self.graph
        if graph.pairs is not None:
            parts.append(values.withColumnRenamed("node", "src").join(graph.links, "src").select(
                *keys, F.col("dst").alias("node"), "v"))
        if graph.members is not None:
            sums = values.join(graph.by_node, "node").groupBy(*keys, "kind", "hub").agg(F.sum("v").alias("v"))
            parts.append(sums.join(graph.by_hub, ["kind", "hub"]).select(*keys, "node", "v"))
            parts.append(values.join(graph.held, "node").select(*keys, "node", (-F.col("v") * F.col("hubs")).alias("v")))
        return reduce(DataFrame.unionByName, parts).groupBy(*keys, "node").agg(F.sum("v").alias("v"))


def canonical_pairs(links: DataFrame, x: str, y: str, via: str, relationship: str) -> DataFrame:
    """One row per unordered pair of different nodes: smallest via and number of links."""
    return (links.where(F.col(x) != F.col(y))
            .groupBy(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
            .agg(F.min(via).alias("via"), F.count("*").alias("links"))
            .withColumn("relationship", F.lit(relationship)))


def first_relation_wins(frames: list[DataFrame]) -> DataFrame:
    """Merge pair frames; a pair keeps the relation of the earliest frame that has it."""
    ranked = [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)]
    merged = reduce(DataFrame.unionByName, ranked)
    return merged.groupBy("a", "b").agg(
        F.min_by("relationship", "_rank").alias("relationship"), F.min_by("via", "_rank").alias("via"),
        F.sum("links").alias("links"))


def memberships(links: DataFrame, node: str, hub: str, kind: str) -> DataFrame:
    """Distinct (node, kind, hub) rows of a bipartite relation."""
    return links.select(F.col(node).alias("node"), F.lit(kind).alias("kind"), F.col(hub).alias("hub")).distinct()


def hub_sizes(members: DataFrame) -> DataFrame:
    """Members per hub and the neighbour pairs they stand for."""
    n = F.col("members")
    return members.groupBy("kind", "hub").agg(F.count("*").alias("members")).withColumn(
        "pairs", (n * (n - 1) / 2).cast("bigint"))
