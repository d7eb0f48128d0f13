"""Exact top-k search by tiled matrix products.

Candidates are dealt into shards and queries into tiles of bounded size.  Every (shard, tile) cell is
one matrix product followed by a partial selection; the partial lists of a query meet in a merge tree
whose nodes join a fixed number of lists.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one side of a cell, and lists that meet in one node of the merge tree.
SHARD_ROWS, TILE_ROWS, FAN_IN = 4096, 1024, 16
#: Doubles hold every integer up to here.
EXACT = 2.0**53


def usable(vector: Column) -> Column:
    """Neither null nor empty, and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating-point matrix product where no sum can leave its exact range."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    if most < EXACT:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    return queries @ candidates.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one row: highest score, then smallest id; partial selection before the sort."""
    places = np.arange(len(scores))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def cell_search(k: int):
    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(queries) and len(candidates):
            matrix, ids = np.stack(candidates["vector"].to_numpy()), candidates["candidate"].to_numpy()
            scores = products(np.stack(queries["ints"].to_numpy()), matrix)
            shard = int(candidates["shard"].iloc[0])
            for row, query in zip(scores, queries["id"].to_numpy(), strict=True):
                others = np.flatnonzero(ids != query)
                top = others[best(row[others], ids[others], k)]
                found.extend((int(query), int(ids[i]), int(row[i]), shard) for i in top)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score", "shard"]).astype("int64")

    return search


def top_k(
    vectors: DataFrame,
    k: int = 20,
    scale: float = 64.0,
    query_modulus: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """The k candidates of highest integer inner product for each query, over all rows.

    Components become ``floor(scale * x)`` in double precision.  Queries are the rows whose id the
    modulus divides.  Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id.

    * Null ids, null or empty vectors and vectors with null or non-finite components take no part.
    * A vector is only compared with vectors of as many components.
    * Rows that repeat an id are rows of their own as candidates (each may be listed) and as one query
      with the first of their vectors in value order; no candidate has the query's own id.
    * An empty table gives an empty result; other columns are ignored.
    """
    vector = F.col(vector_col)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector)).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("ints"),
    )
    is_query = F.col("id") % query_modulus == 0
    n, m = vectors.select(F.col(id_col).cast("long").alias("id")).agg(F.count("id"), F.count_if(is_query)).first()
    shards, tiles = max(1, ceil(n / shard_rows)), max(1, ceil(m / tile_rows))

    # A cell of the grid gets one shard and one tile, so the other side is named by a short list.
    candidates = (
        rows.select(F.col("id").alias("candidate"), F.col("ints").alias("vector"))
        .withColumn("shard", F.pmod(F.xxhash64("candidate", F.lit(1)), F.lit(shards)))
        .withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
        .withColumn("dim", F.size("vector"))
    )
    queries = (
        rows.where(is_query)
        .groupBy("id")
        .agg(F.min("ints").alias("ints"))
        .withColumn("tile", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(tiles)))
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        .withColumn("dim", F.size("ints"))
    )
    keys = ["shard", "tile", "dim"]
    partial = (
        queries.groupBy(*keys)
        .cogroup(candidates.groupBy(*keys))
        .applyInPandas(cell_search(k), "query_id long, vec_id long, score long, shard long")
    )
    order = [F.col("score").desc(), F.col("vec_id")]
    while shards > FAN_IN:
        shards = ceil(shards / FAN_IN)
        partial = partial.withColumn("shard", F.floor(F.col("shard") / FAN_IN))
        node = Window.partitionBy("query_id", "shard").orderBy(*order)
        partial = partial.withColumn("rank", F.row_number().over(node)).where(F.col("rank") <= k).drop("rank")
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


__all__ = ["best", "products", "top_k", "usable"]
