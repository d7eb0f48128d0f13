"""Exact links between members of regions, round by round with pivots, without all pairs of a group.

In the first round a region's first member is its pivot and every other member is compared with it.
Members that are linked to a pivot are in one component and need not be compared with each other.  Of
regions that still hold several components more members become pivots, and pairs whose distances to the
region's pivot differ by more than the radius are left out by the triangle inequality.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorewatch.llm.common import materialize
from shorewatch.llm.components import connected_components

#: Members of a region up to which all pairs are looked at in the first round, and the factor by which pivots grow.
SMALL, GROWTH = 8, 8


def pairs_in_regions(members: DataFrame, pivots: Column, condition: Column) -> DataFrame:
    """Distinct pairs a < b of different components that meet in a region, one of them a pivot there."""
    side = lambda x: [F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in members.columns if c not in ("region", "node")]]
    met = members.where(pivots).select("region", *side("a")).join(members.select("region", *side("b")), "region")
    met = met.where((F.col("a") != F.col("b")) & (F.col("a_component") != F.col("b_component")) & condition)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_regions(
    members: DataFrame,
    measure: Callable[[DataFrame], DataFrame],
    condition: Column,
    radius: float | None = None,
    small: int = SMALL,
    growth: int = GROWTH,
) -> DataFrame:
    """(node, component) of the nodes that links connect.

    ``members`` has region, node and what the condition on ``a_`` and ``b_`` columns needs; each node once
    in a region.  ``measure`` takes pairs (a, b) and returns (a, b, distance, linked); a null distance
    takes part in no window.  A region is done when its members are in one component or all have
    been pivots, so every pair that meets the condition is measured or settled otherwise.
    """
    sizes = members.select("region", "node").groupBy("region").agg(F.count("*").alias("count"), F.min("node").alias("pivot"))
    members = members.join(materialize(sizes.where("count > 1"), "regions"), "region")
    members = members.withColumn("component", F.col("node")).withColumn("away", F.lit(None).cast("double"))
    # Turns come from a hash, so about as many members have had one as there are turns.
    members = members.withColumn("turn", F.pmod(F.xxhash64("region", "node"), F.col("count")) + 1)
    members = materialize(members, "members")
    measured: DataFrame | None = None
    pivots, turns, whole = F.col("node") == F.col("pivot"), 1, small
    while True:
        pairs = pairs_in_regions(members, pivots | (F.col("count") <= whole), condition)
        if measured is not None:
            pairs = pairs.join(measured.select("a", "b"), ["a", "b"], "left_anti")
        found = measure(materialize(pairs, "pairs"))
        measured = found if measured is None else measured.unionByName(found)
        joined = materialize(connected_components(measured.where("linked").select("a", "b")), "components")
        # What is still open: regions of several components whose members have not all been pivots.
        members = members.where(F.col("count") > max(whole, turns)).drop("component", "away")
        members = members.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        apart = members.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        members = members.join(materialize(apart.where("low <> high").select("region"), "apart"), "region", "left_semi")
        known = measured.where("distance IS NOT NULL").select(F.col("a").alias("pivot"), F.col("b").alias("node"), F.col("distance").alias("away"))
        known = known.union(known.select("node", "pivot", "away"))
        members = materialize(members.join(known, ["pivot", "node"], "left"), "members")
        if members.isEmpty():
            return joined
        if radius is not None and turns == 1:
            condition = condition & F.coalesce(F.abs(F.col("a_away") - F.col("b_away")) <= radius + 1e-9, F.lit(True))
        turns, whole = turns * growth, whole * growth
        pivots = F.col("turn") <= turns
