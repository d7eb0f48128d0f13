"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorewatch.llm.common import materialize


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "star")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them; edges come as a > b."""
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "star")
    inner = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.union(least.toDF("a", "b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge in columns a and b; component is the smallest node reachable.

    Each round writes its edges, so the lineage stays short; minima are combined before any shuffle and
    written before they are joined, so a hub of any degree can be split by the adaptive join.
    """
    pairs = edges.where("a <> b").select(
        F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")
    )
    edges = materialize(pairs.distinct(), "edges")
    state = None
    while True:
        edges = materialize(small_star(materialize(large_star(edges), "edges")), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct()
    )
