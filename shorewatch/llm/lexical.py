"""Ranked lexical search over norm buckets.

The terms of all queries span a space in which a document is a vector of impacts and a query a vector of term
weights; the score is their inner product.  Document vectors are sorted by length into buckets, each an eighth
of a bit wide at most, and written in that order.  Rounds of growing size take the buckets from the longest on,
knowing for each query the score it has to reach.  A bucket whose greatest length times the query's length
(Cauchy-Schwarz) stays below is passed over; inside, the coordinates of the query's heaviest terms and the
length that is left bound each document, and what may reach the score is computed exactly in integers.  The
search ends with the first bucket that is too short for every query.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shorewatch.llm.common import item_table, materialize
from shorewatch.llm.words import ragged, raw_texts, words

#: Bytes of queries in one pass, buckets for each doubling of the length, vectors of the first round and the factor
#: by which rounds grow, and terms of a query whose coordinates are looked at before the rest is bounded.
QUERY_BYTES, PER_DOUBLING, FIRST, GROWTH, FOCUS = 1 << 21, 8, 4096, 8, 6
#: Room for rounding in bounds that are computed in doubles.
ROOM = 1 + 1e-9


@dataclass
class Queries:
    """Items of a block: ids, terms by number, and each query's term numbers."""

    ids: list[str]
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple[str, str]]) -> Queries:
        vocabulary: dict[bytes, int] = {}
        own: dict[str, set[int]] = {}
        for key, text in sorted(rows):
            found = words(text.encode("utf-8", "surrogatepass"))
            own.setdefault(key, set()).update(vocabulary.setdefault(w, len(vocabulary)) for w in found)
        held = {k: np.array(sorted(v), np.int64) for k, v in own.items() if v}
        return Queries(list(held), vocabulary, list(held.values()))


def count_terms(queries: Queries):
    """(key, no_id, n, terms, tfs) of each text with terms; only the queries' terms are told."""
    vocabulary = queries.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for place, raw in enumerate(raw_texts(batch.column(2))):
                found = words(raw)
                if found:
                    counted = Counter(found)
                    known = [(vocabulary[t], counted[t]) for t in counted.keys() & vocabulary.keys()]
                    known.sort()
                    for column, value in zip(rows, (place, len(found), [t for t, _ in known], [f for _, f in known]), strict=True):
                        column.append(value)
            at = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(pa.int32())), pa.array(rows[3], pa.list_(pa.int64()))],
                ["key", "no_id", "n", "terms", "tfs"],
            )

    return run


class Best:
    """The k best of one query so far: highest score, then smallest key, rows without id last."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, least
        self.rows = (np.zeros(0, np.int64),) * 3

    def add(self, score: np.ndarray, no_id: np.ndarray, key: np.ndarray) -> None:
        rows = [np.concatenate(x) for x in zip(self.rows, (score, no_id, key), strict=True)]
        order = np.lexsort((rows[2], rows[1], -rows[0]))[: self.k]
        self.rows = tuple(x[order] for x in rows)
        if len(order) == self.k:
            self.least = max(self.least, int(self.rows[0][-1]))


def search(queries: Queries, weights: np.ndarray, least: list[int], k: int):
    """The best of each query among the vectors of a task, each batch a piece of a bucket or of several."""
    # Heaviest terms first; lengths of the query and of what follows its focus.
    sorted_terms = [t[np.argsort(-weights[t], kind="stable")] for t in queries.terms]
    norms = np.array([np.sqrt((weights[t].astype(float) ** 2).sum()) for t in sorted_terms])
    rest = np.array([np.sqrt((weights[t[FOCUS:]].astype(float) ** 2).sum()) for t in sorted_terms])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, x) for x in least]
        weight_of = np.zeros(len(weights), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, impacts = batch.column(2), batch.column(3)
            ends = lists.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            terms = lists.flatten().to_numpy(zero_copy_only=False)
            impacts = impacts.flatten().to_numpy(zero_copy_only=False)
            key, no_id = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            length = batch.column(4).to_numpy(zero_copy_only=False)
            rows, longest = batch.num_rows, length.max()
            # The columns of the piece: documents and impacts by term.
            by = np.argsort(terms, kind="stable")
            of_term, own = impacts[by], np.repeat(np.arange(rows), np.diff(ends))[by]
            edges = np.searchsorted(terms[by], np.arange(len(weights) + 1))
            largest = np.zeros(len(weights))
            filled = np.flatnonzero(edges[1:] > edges[:-1])
            largest[filled] = np.maximum.reduceat(of_term, edges[filled])
            for q in np.flatnonzero(norms * longest * ROOM >= [max(b.least, 1) for b in best]):
                held, mine = best[q], sorted_terms[q]
                known, square = np.zeros(rows), np.zeros(rows)
                for term in mine[:FOCUS]:
                    at = slice(edges[term], edges[term + 1])
                    known[own[at]] += weights[term] * of_term[at]
                    square[own[at]] += of_term[at].astype(float) ** 2
                tail = mine[FOCUS:]
                bound = rest[q] * np.sqrt(np.maximum(length**2 * ROOM - square, 0))
                bound = known + np.minimum(bound, (weights[tail] * largest[tail]).sum())
                left = np.flatnonzero(bound * ROOM >= max(held.least, 1))
                if not len(left):
                    continue
                weight_of[mine] = weights[mine]
                sizes = ends[left + 1] - ends[left]
                at = np.repeat(ends[left], sizes) + ragged(sizes)
                sums = np.concatenate(([0], np.cumsum(weight_of[terms[at]] * impacts[at])))
                weight_of[mine] = 0
                upto = np.cumsum(sizes)
                score = sums[upto] - sums[upto - sizes]
                reached = (score > 0) & (score >= held.least)
                held.add(score[reached], no_id[left[reached]], key[left[reached]])
        name = np.repeat(np.arange(len(best)), [len(b.rows[0]) for b in best])
        score, no_id, key = (np.concatenate([b.rows[i] for b in best]) if best else np.zeros(0, np.int64) for i in range(3))
        yield pa.RecordBatch.from_arrays(
            [pa.array(name, pa.int64()), pa.array(score, pa.int64()), pa.array(no_id.astype(bool), pa.bool_()), pa.array(key, pa.int64())],
            ["query", "score", "no_id", "key"],
        )

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "no_id", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(rows: DataFrame, queries: Queries, k: int, first: int, growth: int) -> DataFrame:
    counted = rows.mapInArrow(count_terms(queries), "key long, no_id boolean, n long, terms array<int>, tfs array<long>")
    counted = materialize(counted, "terms")
    documents, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(queries.vocabulary), np.int64)
    # At most one row a term of the block.
    for term, df in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[term] = int(1000 * log((2 * documents + 2) / (2 * df + 1)))
    wide = F.expr(f"10L + (90L * n * {documents}L) div {max(1, total)}L").alias("m")
    impacts = F.expr("transform(tfs, f -> (1000000000L * f) div (1000L * f + 8L * m))").alias("impacts")
    squares = F.aggregate("impacts", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    vectors = (
        counted.where(F.size("terms") > 0)
        .select("*", wide)
        .select("key", "no_id", "terms", impacts)
        .withColumn("length", F.sqrt(squares))
        .where("length > 0")
        .withColumn("bucket", F.ceil(F.log2("length") * PER_DOUBLING).cast("int"))
    )
    # A bucket may hold any number of vectors, so equal buckets are dealt out by key.
    spread = vectors.repartitionByRange(F.desc("bucket"), F.xxhash64("key")).sortWithinPartitions(F.desc("length"))
    vectors = materialize(spread, "vectors")
    # Buckets are a few for each doubling of a length, whatever the number of documents.
    sizes = sorted(((r["bucket"], r["count"]) for r in vectors.groupBy("bucket").count().collect()), reverse=True)
    norms = [np.sqrt((weights[t].astype(float) ** 2).sum()) for t in queries.terms]
    least, found, wanted = [1] * len(queries.ids), None, first
    while sizes:
        top, taken, low = sizes[0][0], 0, 0
        while sizes and taken < wanted:
            low, count = sizes.pop(0)
            taken += count
        wanted *= growth
        if not any(norm * 2.0 ** (top / PER_DOUBLING) * ROOM >= s for norm, s in zip(norms, least, strict=True)):
            break
        piece = vectors.where((F.col("bucket") <= top) & (F.col("bucket") >= low)).select("key", "no_id", "terms", "impacts", "length")
        new = piece.mapInArrow(search(queries, weights, least, k), "query long, score long, no_id boolean, key long")
        new = new if found is None else new.unionByName(found.drop("rank"))
        found = materialize(ranked(new, k), "best")
        # One row a query of the block.
        for query, score in found.where(F.col("rank") == k).select("query", "score").collect():
            least[query] = score
    if found is None:
        found = rows.sparkSession.createDataFrame([], "query long, score long, no_id boolean, key long, rank int")
    return found


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    query_bytes: int = QUERY_BYTES,
    first: int = FIRST,
    growth: int = GROWTH,
) -> DataFrame:
    """(item id, rank, document id, score): the ``k`` documents of highest score above 0 for each item.

    Terms are maximal runs of letters and digits, all characters beyond ASCII among them, A-Z in lower case; an
    item's terms count once.  Weights, impacts and scores are those of the integer formula in ``search_block``.

    * Null and empty texts have no terms and count in no statistic.
    * Rows that repeat an item's id are one item with the terms of all; items without id or terms get no rows.
    * Every document row is one of its own, also where its id repeats; equal scores go by ascending id, rows
      without id last.
    * Empty tables of documents or items give an empty result; other columns are ignored; texts are read whole.
    """
    key = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(key, F.lit((1 << 63) - 1)).alias("key"), key.isNull().alias("no_id"), F.col(text_col).alias("text"))
    table, blocks = item_table(items, item_col, item_text_col, query_bytes)
    kind = items.schema[item_col].dataType
    out = None
    for block in range(blocks):
        queries = Queries.of([(r["id"], r["text"]) for r in table.where(F.col("block") == block).select("id", "text").collect()])
        found = search_block(rows, queries, k, first, growth)
        names = docs.sparkSession.createDataFrame(list(enumerate(queries.ids)), "query long, name string")
        # At most ``k`` rows for each query of the block, whose number is bounded.
        found = found.join(F.broadcast(names), "query").select(
            F.col("name").cast(kind).alias(item_col), "rank", F.expr("if(no_id, NULL, key)").alias(id_col), "score"
        )
        out = found if out is None else out.unionByName(found)
    return out


__all__ = ["rank_documents"]
