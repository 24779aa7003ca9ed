"""Reachability over directed edge frames (src_id, dst_id), one frontier at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from kgspark.session import cut_lineage


def closure(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src_id, dst_id, depth): every reachable pair at its smallest depth, self pairs left out.

    Each level joins only the newest pairs with the edges and drops pairs already known,
    so cycles end by themselves and no path is followed twice.
    """
    steps = cut_lineage(edges.select("src_id", "dst_id").where("src_id <> dst_id").distinct())
    frontier = steps.withColumn("depth", F.lit(1))
    levels = [frontier]
    depth = 1
    while max_depth is None or depth < max_depth:
        depth += 1
        known = reduce(DataFrame.unionByName, levels).select("src_id", "dst_id")
        hop = steps.select(F.col("src_id").alias("mid"), F.col("dst_id").alias("next"))
        found = (frontier.select("src_id", F.col("dst_id").alias("mid")).join(hop, "mid")
                 .where("src_id <> next").select("src_id", F.col("next").alias("dst_id")).distinct()
                 .join(known, ["src_id", "dst_id"], "left_anti").withColumn("depth", F.lit(depth)))
        frontier = cut_lineage(found)
        if frontier.isEmpty():
            break
        levels.append(frontier)
    return reduce(DataFrame.unionByName, levels)


def reflexive_closure(edges: DataFrame, nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Closure plus every node reaching itself at depth 0; ``nodes`` has column id."""
    own = nodes.select(F.col("id").alias("src_id"), F.col("id").alias("dst_id"),
                       F.lit(0).alias("depth"))
    return closure(edges, max_depth).unionByName(own)
