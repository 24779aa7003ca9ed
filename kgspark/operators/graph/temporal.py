"""How a network changes over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def evolution(tenures: DataFrame, entity: str, member: str, value: str) -> DataFrame:
    """Per start year: distinct entities and members, and the total value."""
    return tenures.groupBy(F.year("start_date").alias("year")).agg(
        F.count_distinct(entity).alias("entities"), F.count_distinct(member).alias("members"),
        F.sum(value).alias("total"))


def busiest(tenures: DataFrame, member: str, n: int = 10) -> DataFrame:
    """Members with the most tenures; ties go to the smaller key."""
    return tenures.groupBy(member).agg(F.count("*").alias("move_count")).orderBy(
        F.desc("move_count"), member).limit(n)


def corridors(moves: DataFrame, from_place: str, to_place: str, day: str) -> DataFrame:
    """Yearly moves per corridor and the change since the year before with any move.

    The window runs over yearly counts, at most one row per year and corridor.
    """
    yearly = moves.groupBy(from_place, to_place, F.year(day).alias("year")).agg(F.count("*").alias("moves"))
    before = F.lag("moves").over(Window.partitionBy(from_place, to_place).orderBy("year"))
    return yearly.withColumn("previous_moves", before).withColumn(
        "change", F.col("moves") - F.col("previous_moves"))


def yearly_network(links: DataFrame, a: str, b: str, day: str) -> DataFrame:
    """Nodes, edges, density and mean degree of each year's undirected network."""
    edges = links.where(F.col(a) != F.col(b)).select(
        F.year(day).alias("year"), F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct()
    sizes = edges.groupBy("year").agg(F.count("*").alias("edges"))
    nodes = edges.select("year", F.explode(F.array("x", "y")).alias("n")).groupBy("year").agg(
        F.count_distinct("n").alias("nodes"))
    n, e = F.col("nodes").cast("double"), F.col("edges").cast("double")
    return sizes.join(nodes, "year").select(
        "year", "nodes", "edges", F.when(n > 1, 2 * e / (n * (n - 1))).otherwise(0.0).alias("density"),
        (2 * e / n).alias("mean_degree"))


def within(tenures: DataFrame, first=None, last=None) -> DataFrame:
    """Tenures starting in [first, last]; applied only when both days are given."""
    if first is None or last is None:
        return tenures
    return tenures.where(F.col("start_date").between(F.lit(first), F.lit(last)))
