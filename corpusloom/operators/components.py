"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.runtime import durable


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Each step only ever takes a minimum per node, combined map-side, and joins one row per node back, so
    a hub never gathers its neighbours. Every round is checkpointed; rounds grow with the logarithm of
    the node count.
    """
    links = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    links = durable(links)
    while not _are_stars(links):
        links = durable(_small_star(_large_star(links)))
    leaves = links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return leaves.unionByName(roots)


def _are_stars(links: DataFrame) -> bool:
    """True when every larger end has one smaller end, which is itself no larger end."""
    ends = links.select(F.col("hi").alias("node"), F.lit(1).alias("up")).unionByName(
        links.select(F.col("lo").alias("node"), F.lit(0).alias("up"))
    )
    per_node = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("lowest"))
    return per_node.where("ups > 1 OR (ups = 1 AND lowest = 0)").isEmpty()


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    up = links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    return up.join(smallest, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    smallest = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(smallest, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(smallest.select("hi", F.col("m").alias("lo"))).distinct()
