"""Packing pieces of tokenized documents into sequences by vector best fit.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared lengths).
Pieces go, longest first, into the open sequence that fits them best under every capacity, by the
smallest weighted norm of what would be left or by the largest weighted dot product of piece and rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorewatch.llm.common import free_names, materialize
from shorewatch.llm.tokens import Encoder

#: Pieces that one task packs at once; sequences filled less than this are opened again and packed anew.
SHARD_PIECES, LOOSE = 8192, 0.98


class Capacity(NamedTuple):
    """What a sequence holds at most, and the weight of each part in choosing one."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"


def tokenized_pieces(
    docs: DataFrame,
    definition: str,
    max_tokens: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``max_tokens`` ids of each document: its text's ids and then ``end_id``.

    Returns id, piece, start, length, ids_crc32 and, if asked for, ids.  ``definition`` is the JSON of a
    tokenizer file; it is broadcast, and its size is that of the file.  Null and empty texts are one piece
    of ``end_id`` alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    step, end = 4 * max_tokens, end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                ids = (encoder.encode(text) if isinstance(text, str) else b"") + end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    row = (key, at // step, at // 4, len(piece) // 4, zlib.crc32(piece))
                    rows.append((*row, np.frombuffer(piece, "<u4")) if with_ids else row)
            names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            out = pd.DataFrame(rows, columns=names)
            out["id"] = out["id"].astype("Int64")
            yield out

    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    ids = ", ids array<long>" if with_ids else ""
    return slim.mapInPandas(cut, f"id long, piece int, start long, length long, ids_crc32 long{ids}")


def best_fit(lengths: np.ndarray, capacity: Capacity) -> np.ndarray:
    """Sequence numbers of pieces that come longest first."""
    most = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weights = np.array(capacity.weights)
    rest = np.empty((len(lengths), 3))
    number = np.empty(len(lengths), np.int64)
    chosen = np.empty(len(lengths), np.int64)
    open_ = opened = 0
    for i, length in enumerate(lengths):
        need = np.array([length, 1.0, float(length) * length]) / most
        left = rest[:open_] - need
        fits = np.flatnonzero((left >= -1e-12).all(axis=1))
        if len(fits):
            if capacity.rule == "norm":
                at = fits[((left[fits] ** 2) @ weights).argmin()]
            else:
                at = fits[(rest[fits] @ (weights * need)).argmax()]
            rest[at] = left[at]
        else:
            at, open_ = open_, open_ + 1
            rest[at], number[at] = 1.0 - need, opened
            opened += 1
        chosen[i] = number[at]
        # A sequence that nothing can go into any more is closed; the last open one takes its place.
        if (rest[at] * most < 1 - 1e-9).any():
            open_ -= 1
            rest[at], number[at] = rest[open_], number[open_]
    return chosen


def shard_packer(capacity: Capacity, round_: int, shard_col: str, filled_col: str):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "piece", "start"], ascending=[False, True, True, True], ignore_index=True)
        sequence = best_fit(rows["length"].to_numpy(), capacity)
        shard = int(rows[shard_col].iloc[0])
        # Rounds, shards and sequences have parts of the number of their own.
        rows["sequence_id"] = (round_ << 58) + (shard << 20) + sequence
        rows = rows.sort_values(["sequence_id", "length"], ascending=[True, False], kind="stable", ignore_index=True)
        by = rows.groupby("sequence_id")["length"]
        rows["offset"] = by.cumsum() - rows["length"]
        rows[filled_col] = by.transform("sum")
        return rows.drop(columns=shard_col)

    return pack


def pack_pieces(pieces: DataFrame, capacity: Capacity, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces with id, piece, start and length (replacing columns of these names); other columns stay.

    Pieces are dealt into shards of bounded size by a hash and each shard is packed by itself.  What
    ends in sequences that are not well filled is dealt into fewer shards and packed anew, until it is
    one shard or does not get less, so that the shards' ends do not add up.  A piece longer than the token
    capacity raises an error.  Null ids and repeated pieces are allowed; an empty table stays empty.
    """
    if capacity.rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(*[F.col(f"`{c}`") for c in columns])
    shard_col, filled_col = free_names([*columns, "sequence_id", "offset"], "shard", "filled")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    n, longest = pieces.agg(F.count("*"), F.max("length")).first()
    if (longest or 0) > capacity.tokens or (longest or 0) ** 2 > capacity.attention or capacity.documents < 1:
        raise ValueError("a piece is over the capacity of an empty sequence")
    todo, done, round_ = pieces, [], 0
    while True:
        shards = max(1, ceil(n / shard_pieces))
        keyed = todo.withColumn(shard_col, F.pmod(F.xxhash64(F.lit(round_), "id", "piece", "start"), F.lit(shards)))
        packed = keyed.groupBy(shard_col).applyInPandas(
            shard_packer(capacity, round_, shard_col, filled_col), f"{schema}, sequence_id long, offset long, `{filled_col}` long"
        )
        packed = materialize(packed, "packed")
        loose = packed.where(F.col(filled_col) < LOOSE * capacity.tokens)
        m = loose.count() if shards > 1 else 0
        if shards == 1 or m == 0 or ceil(m / shard_pieces) > 0.7 * shards:
            break
        done.append(packed.where(F.col(filled_col) >= LOOSE * capacity.tokens))
        todo, n, round_ = loose.select(*[F.col(f"`{c}`") for c in columns]), m, round_ + 1
    for part in done:
        packed = packed.unionByName(part)
    return packed.drop(filled_col)


def pack_documents(
    docs: DataFrame, definition: str, capacity: Capacity = Capacity(), with_ids: bool = False, **columns: str
) -> DataFrame:
    """Documents as packed pieces: id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    Only documents longer than a sequence are cut.  Null and empty texts have the end id alone; rows
    with null or repeated ids are documents of their own.
    """
    pieces = tokenized_pieces(docs, definition, capacity.tokens, with_ids=with_ids, **columns)
    return pack_pieces(materialize(pieces, "pieces"), capacity)
