"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected to eight dimensions once per table and decoded to their nearest point of the
E8 lattice.  A vector is entered in the cell of that point and in those of the lattice points next
nearest to its projection; vectors that meet in a cell are compared by their cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorewatch.llm.common import materialize
from shorewatch.llm.components import connected_components
from shorewatch.llm.topk import usable

#: Tables, neighbouring cells entered per table, and lattice units that a projected unit vector spans.
TABLES, PROBES, SCALE = 8, 2, 0.8
#: Vectors of one side of a block of a cell.
BLOCK_ROWS = 512


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps from a lattice point to its neighbours."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            step = np.zeros(8)
            step[i], step[j] = a, b
            whole.append(step)
    halves = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.vstack([np.array(whole), np.array(halves)])


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum: round, and where the sum is odd round the worst component the other way."""
    point = np.rint(x)
    error = x - point
    worst = np.abs(error).argmax(axis=1)
    rows = np.flatnonzero(point.sum(axis=1) % 2 != 0)
    point[rows, worst[rows]] += np.where(error[rows, worst[rows]] >= 0, 1.0, -1.0)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by one half."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def cells(unit: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """Cell keys of each row: per table its own cell, then the cells of the nearest neighbouring lattice points."""
    steps, n = minimal_vectors(), len(unit)
    keys = np.empty((n, tables, 1 + probes), np.int64)
    rng = np.random.default_rng([seed, unit.shape[1]])
    weights = rng.integers(1, 2**62, size=8, dtype=np.int64) * 2 + 1
    with np.errstate(over="ignore"):
        for t in range(tables):
            x = unit @ rng.standard_normal((unit.shape[1], 8)) / scale
            home = nearest_e8(x)
            # Of all neighbours, those whose step points most along the error are nearest.
            near = np.argsort(-((x - home) @ steps.T - 0.5 * (steps**2).sum(axis=1)), axis=1)[:, :probes]
            points = np.concatenate([home[:, None, :], home[:, None, :] + steps[near]], axis=1)
            doubled = np.rint(points * 2).astype(np.int64)
            keys[:, t, :] = ((doubled * weights).sum(axis=2) * np.int64(2 * tables + 1)) ^ np.int64(t)
    return keys


def unit_rows(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype(np.float64)
    largest = np.abs(matrix).max(axis=1, keepdims=True)
    matrix = matrix / largest
    return matrix / np.sqrt((matrix**2).sum(axis=1, keepdims=True))


def coder(tables: int, probes: int, scale: float, seed: int):
    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, rows in batch.groupby(batch["vector"].map(len)):
                unit = unit_rows(rows["vector"])
                keys = cells(unit, tables, probes, scale, seed).reshape(len(rows), -1)
                yield pd.DataFrame(
                    {"rep": rows["rep"], "weight": rows["weight"], "unit": list(unit), "entries": list(keys)}
                )

    return code


def first_meeting(entries: np.ndarray, i: np.ndarray, j: np.ndarray, tables: int) -> np.ndarray:
    """The key of the first cell, in table order, that rows i and j have in common."""
    width = entries.shape[1] // tables
    first, open_ = np.zeros(len(i), np.int64), np.ones(len(i), bool)
    for t in range(tables):
        for column in range(t * width, (t + 1) * width):
            left = entries[i, column]
            met = open_ & (entries[j, t * width : (t + 1) * width] == left[:, None]).any(axis=1)
            first[met], open_ = left[met], open_ & ~met
    return first


def first_rows(rows: pd.DataFrame) -> np.ndarray:
    """Where each block of each cell begins, for sorted rows."""
    names = rows[["key", "a", "b"]].to_numpy()
    return np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]).any(axis=1))))


def block_pairs(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of one block of each cell, for rows sorted by cell and block; a pair may come twice."""
    start = first_rows(rows)
    size = np.diff(np.concatenate((start, [len(rows)])))
    begin, length = np.repeat(start, size), np.repeat(size, size)
    # Row i of a cell meets the rows after it.
    later = begin + length - 1 - np.arange(len(rows))
    i = np.repeat(np.arange(len(rows)), later)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
    block, a, b = rows["block"].to_numpy(), rows["a"].to_numpy(), rows["b"].to_numpy()
    across = (block[i] != block[j]) | (a[i] == b[i])
    return i[across], j[across]


def block_links(threshold: float, tables: int, pairs_at_once: int = 200_000):
    """Of many blocks of cells: what each row's links weigh, and ties that connect what is linked; never pairs."""

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        # A row that has come to a cell from its own probes and home, or from both sides of a block, counts once.
        rows = rows.drop_duplicates(["key", "a", "b", "rep"]).sort_values(["key", "a", "b"], ignore_index=True)
        names, number = np.unique(rows["rep"].to_numpy(), return_inverse=True)
        once = np.unique(number, return_index=True)[1]
        unit = np.stack(rows["unit"].to_numpy()[once])
        entries = np.stack(rows["entries"].to_numpy()[once])
        weight, key = rows["weight"].to_numpy()[once], rows["key"].to_numpy()
        links, root = np.zeros(len(names), np.int64), np.arange(len(names))
        # Blocks are cut into runs of about as many pairs as are compared at once.
        begins = first_rows(rows)
        sizes = np.diff(np.concatenate((begins, [len(rows)])))
        run = np.cumsum(sizes * sizes) // pairs_at_once
        cuts = begins[np.concatenate(([True], run[1:] != run[:-1]))].tolist()
        for low, high in zip(cuts, [*cuts[1:], len(rows)], strict=True):
            i, j = block_pairs(rows.iloc[low:high])
            at, i, j = i + low, number[i + low], number[j + low]
            near = np.concatenate(
                [np.einsum("ij,ij->i", unit[i[x : x + 50_000]], unit[j[x : x + 50_000]]) >= threshold for x in range(0, len(i), 50_000)]
                or [np.zeros(0, bool)]
            )
            at, i, j = at[near], i[near], j[near]
            if len(i) == 0:
                continue
            here = first_meeting(entries, i, j, tables) == key[at]
            np.add.at(links, i[here], weight[j[here]])
            np.add.at(links, j[here], weight[i[here]])
            settled = False
            while not settled:
                least, before = np.minimum(root[i], root[j]), root.copy()
                np.minimum.at(root, i, least)
                np.minimum.at(root, j, least)
                root = root[root]
                settled = np.array_equal(before, root)
        out = pd.DataFrame({"rep": names, "links": links, "root": names[root]})
        return out[(links > 0) | (out["root"] != out["rep"])]

    return link


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = TABLES,
    probes: int = PROBES,
    scale: float = SCALE,
    block_rows: int = BLOCK_ROWS,
    seed: int = 8,
) -> DataFrame:
    """Links between vectors of cosine at or above the threshold, and what they connect.

    Returns one row per input row: the id, n_links (other rows linked directly), component_id (smallest
    id reachable) and kept (the id is its component's).  No pair below the threshold is linked; the share
    of pairs found is set by ``tables``, ``probes`` and ``scale``.  Equal vectors are one class that is
    coded once and weighs as many rows as it has.  A cell of many vectors is dealt into blocks, and pairs
    of blocks are compared apart; a block gives counts and spanning ties, not pairs.

    * Null, empty and zero vectors and vectors with null or non-finite components link with nothing.
    * Vectors of different length do not link.  A row without an id has no component and is not kept;
      it counts as nobody's link.
    * Rows that repeat an id are rows of their own: equal ones link with each other.
    * An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col)
    some = F.exists(vector, lambda x: x != 0)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.when(F.col(id_col).isNotNull() & usable(vector) & some, vector).alias("vector"),
    ).select("id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    classes = (
        rows.where("vector IS NOT NULL")
        .groupBy("h1", "h2")
        .agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    )
    classes = materialize(classes, "classes")
    # Several classes may share an id where a row's id repeats, so classes go by a number of their own.
    numbered = classes.select(F.xxhash64("h1", "h2").alias("rep"), "weight", F.col("vector").cast("array<double>"))
    coded = materialize(
        numbered.mapInPandas(
            coder(tables, probes, scale, seed), "rep long, weight long, unit array<double>, entries array<long>"
        ),
        "coded",
    )
    entered = coded.select("rep", F.explode("entries").alias("key"))
    shared = materialize(entered.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "cells")
    blocks = F.ceil(F.col("n") / block_rows)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    placed = (
        entered.join(shared, "key")
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")))
        .select("rep", "key", "block", other.alias("other"))
        .select("rep", "key", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    )
    # Blocks are small as a rule, so many of them go to one call.
    placings = shared.agg(F.sum(F.col("n") * blocks)).first()[0] or 0
    batches = max(1, ceil(placings / (8 * block_rows)))
    found = materialize(
        placed.join(coded, "rep")
        .groupBy(F.pmod(F.xxhash64("key", "a", "b"), F.lit(batches)))
        .applyInPandas(block_links(threshold, tables), "rep long, links long, root long"),
        "links",
    )
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = classes.select(F.xxhash64("h1", "h2").alias("node"), "h1", "h2", F.col("rep").alias("least"), "weight")
    grouped = (
        named.join(joined, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .join(counted.withColumnRenamed("rep", "node"), "node", "left")
    )
    grouped = materialize(grouped, "grouped")
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    resolved = materialize(
        grouped.join(materialize(smallest, "smallest"), "component").select(
            "h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links")
        ),
        "resolved",
    )
    lone = F.col("vector").isNull()
    alone = rows.where(lone).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    linked = rows.where(~lone).join(resolved, ["h1", "h2"]).select("id", F.col("links").alias("n_links"), "component_id")
    return (
        alone.unionByName(linked)
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
        .withColumnRenamed("id", id_col)
    )
