"""Positions against sorting in Python."""

from pyspark.sql import functions as F

from shorewatch.operators.positions import numbered


def test_positions_of_a_dominant_group(spark):
    rows = [("big" if i % 3 else f"k{i % 50}", (i * 7919) % 1009, i) for i in range(3000)] + [(None, None, -1), (None, 4, -2)]
    frame = spark.createDataFrame(rows, "key string, at long, id long").repartition(16)
    got = numbered(frame, ["key"], [F.col("at").asc_nulls_first(), F.col("id")]).collect()
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: i for i, r in enumerate(own, 1)}
    assert {r["id"]: r["seq"] for r in got} == want and len(got) == len(rows)


def test_no_rows(spark):
    assert numbered(spark.createDataFrame([], "key string, at long"), ["key"], [F.col("at")]).columns == ["key", "at", "seq"]
