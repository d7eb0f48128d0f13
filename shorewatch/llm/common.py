"""Shared folders and written tables between the steps of an operator."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, or below the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base.rstrip('/')}/{name}-{uuid4().hex}"


#: Files of a written table for each task that the cluster runs at once.
FILES_PER_SLOT = 4


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows of a frame as a written table, so that no later step computes them again.

    Partitions beyond a few for each task slot are written one after another into the same file: they are
    still computed and held one at a time, and small tables do not fall into thousands of files.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.coalesce(FILES_PER_SLOT * spark.sparkContext.defaultParallelism).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_table(items: DataFrame, id_col: str, text_col: str, at_once: int) -> tuple[DataFrame, int]:
    """Distinct (id as text, text, block) of the items that have both, and the number of blocks.

    A block, about ``at_once`` bytes of whole items, is what one pass over the documents looks at; the rows of an
    item are in one block.
    """
    rows = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).distinct()
    blocks = max(1, -(-int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // at_once))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    return (materialize(rows, "items") if blocks > 1 else rows), blocks


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Names like those wanted that no column has, letter case aside."""
    used = {c.lower() for c in taken}
    found = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        found.append(name)
    return found
