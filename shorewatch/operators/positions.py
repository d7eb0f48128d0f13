"""Exact positions of rows inside their group, however large one group is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shorewatch.operators.tables import written

#: Bits of a monotonically increasing id that count rows inside a partition.
_ROW_BITS = 33


def running(frame: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds the sums of the rows before each row, among the rows of equal ``keys`` (nulls are equal) in the given order.

    The rows are dealt out by ranges of keys and order together, so a group that holds most rows lies in many
    partitions, and are written in that order.  Sums run inside a group's rows of one partition, and then over one
    row for each group and partition; no window runs over all rows of a group.
    """
    columns, names = frame.columns, list(sums)
    placed = (
        frame.withColumns({f"_own_{n}": c.cast("long") for n, c in sums.items()})
        .repartitionByRange(*[F.col(k) for k in keys], *order)
        .sortWithinPartitions(*[F.col(k) for k in keys], *order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    placed = written(placed, "placed").withColumn("_part", F.shiftright("_row", _ROW_BITS))
    inside = Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part", *keys).agg(*[F.sum(f"_own_{n}").alias(f"_all_{n}") for n in names])
    totals = totals.select(
        F.col("_part").alias("_part2"),
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in names],
    )
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    met = reduce(lambda a, b: a & b, same, F.col("_part") == F.col("_part2"))
    summed = placed.withColumns({f"_in_{n}": F.coalesce(F.sum(f"_own_{n}").over(inside), F.lit(0)) for n in names})
    return summed.join(written(totals, "totals"), met).select(*columns, *[(F.col(f"_in_{n}") + F.col(f"_base_{n}")).alias(n) for n in names])


def numbered(frame: DataFrame, keys: list[str], order: list[Column], name: str = "seq") -> DataFrame:
    """Adds ``name``, the position from 1 of each row among the rows of equal ``keys`` (nulls are equal) in the given order.

    The rows are dealt out by ranges of keys and order together, so a group that holds most rows lies in many
    partitions, and are written in that order.  A row's position is its distance from the first row of its group in
    the same partition plus the rows of the group in the partitions before.  Those sums run over one row for each
    group and partition; no window runs over the rows of a group.  Ties of the order get distinct positions.
    """
    columns = frame.columns
    placed = (
        frame.repartitionByRange(*[F.col(k) for k in keys], *order)
        .sortWithinPartitions(*[F.col(k) for k in keys], *order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    placed = written(placed, "placed").withColumn("_part", F.shiftright("_row", _ROW_BITS))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part", *keys).agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    starts = starts.withColumn("_shift", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1)
    starts = written(starts.select(F.col("_part").alias("_part2"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_shift"), "starts")
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    met = reduce(lambda a, b: a & b, same, F.col("_part") == F.col("_part2"))
    return placed.join(starts, met).select(*columns, (F.col("_row") + F.col("_shift")).alias(name))
