"""Tables written between the steps of a job."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Files of a written table for each task that the cluster runs at once.
FILES_PER_SLOT = 4


def shared_directory(spark: SparkSession, name: str) -> str:
    """A folder below ``spark.checkpoint.dir``, or below the warehouse where that is unset; all executors share both."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}"


def written(frame: DataFrame, name: str, coalesced: bool = True) -> DataFrame:
    """The rows of a frame from a table of their own, so that later steps, also repeated ones, read and don't recompute them.

    Partitions beyond a few for each slot are computed one after another by the same tasks unless they are to stay
    as they are, because some take far longer than others.
    """
    spark = frame.sparkSession
    path = shared_directory(spark, f"{name}-{uuid4().hex}")
    if coalesced:
        frame = frame.coalesce(FILES_PER_SLOT * spark.sparkContext.defaultParallelism)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
