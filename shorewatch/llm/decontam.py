"""Benchmark decontamination by suffix arrays of the training texts.

Training documents are read in shards.  The words of a shard that benchmark items hold too, in runs long
enough for a window, are put in a suffix array; every suffix of every item is searched in it by binary
search.  The neighbours of the place found give the longest verbatim match of the suffix and where it is;
the suffixes that begin with one of the item's windows give all places of that window.  Words inside are
hit, and documents that hold hits can be removed.

Only the items leave their table for the tasks, in blocks of bounded length; documents stay in place and
nothing about them is shuffled, so no passage, item or document is too frequent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shorewatch.llm.common import item_table, materialize
from shorewatch.llm.repeats import suffix_order
from shorewatch.llm.words import ragged, raw_texts, words

#: Words of a window, bytes of items that are searched in one pass, bytes of documents in a shard.
WINDOW, ITEM_BYTES, SHARD_BYTES = 10, 1 << 23, 1 << 24


@dataclass
class TestSuffixes:
    """Items of a block as numbers of words, and where their suffixes and windows begin."""

    ids: list[str]
    vocabulary: dict[bytes, int]
    numbers: np.ndarray
    #: Of each suffix: its item, its place in ``numbers``, its words, and those of its window (0: it begins none).
    item: np.ndarray
    start: np.ndarray
    length: np.ndarray
    window: np.ndarray

    @staticmethod
    def of(items: list[tuple[str, str]], window: int) -> TestSuffixes:
        vocabulary: dict[bytes, int] = {}
        texts = [[vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text.encode("utf-8", "surrogatepass"))] for _, text in items]
        sizes = np.array([len(t) for t in texts], np.int64)
        numbers = np.array([n for t in texts for n in t], np.int64)
        length = np.repeat(sizes, sizes) - ragged(sizes)
        own = np.repeat(np.minimum(sizes, window), sizes)
        return TestSuffixes(
            [i for i, _ in items], vocabulary, numbers, np.repeat(np.arange(len(items)), sizes),
            np.arange(len(numbers)), length, np.where(length >= own, own, 0),
        )


@dataclass
class Shard:
    """Suffix array of the runs of known words in some documents; 0 separates runs."""

    sizes: np.ndarray
    symbols: np.ndarray
    document: np.ndarray
    place: np.ndarray
    order: np.ndarray

    @staticmethod
    def of(texts: list[bytes], tests: TestSuffixes) -> Shard:
        sizes, kept, document, place = np.zeros(len(texts), np.int64), [], [], []
        least = int(tests.window[tests.window > 0].min(initial=WINDOW))
        for i, raw in enumerate(texts):
            found = words(raw)
            sizes[i] = len(found)
            known = np.fromiter(map(tests.vocabulary.get, found, repeat(0)), np.int64, len(found))
            # A run of known words that is shorter than the shortest window holds none.
            edges = np.flatnonzero(np.diff(np.concatenate(([0], known != 0, [0]))))
            begin, end = edges[::2], edges[1::2]
            long = end - begin >= least
            if long.any():
                count = end[long] - begin[long] + 1
                at = np.repeat(begin[long], count) + ragged(count)
                kept.append(np.append(known, 0)[at])
                place.append(at)
                document.append(np.full(len(at), i))
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        symbols = join(kept)
        longest = int(tests.length.max(initial=1))
        order = suffix_order(symbols, longest)[0] if len(symbols) else symbols
        return Shard(sizes, symbols, join(document), join(place), order)

    def common(self, tests: TestSuffixes, suffix: np.ndarray, most: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that test suffixes share with training suffixes, ``most`` at most, and whether the training one is less."""
        shared, less = np.zeros(len(suffix), np.int64), np.zeros(len(suffix), bool)
        going = np.flatnonzero(most > 0)
        for depth in range(int(most.max(initial=0))):
            place = at[going] + depth
            # Behind the last separator there is nothing; a separator is less than any word.
            theirs = np.where(place < len(self.symbols), self.symbols[np.minimum(place, len(self.symbols) - 1)], 0)
            ours = tests.numbers[tests.start[suffix[going]] + depth]
            less[going[theirs < ours]] = True
            going = going[theirs == ours]
            shared[going] += 1
            going = going[most[going] > depth + 1]
            if not len(going):
                break
        return shared, less

    def search(self, tests: TestSuffixes, suffix: np.ndarray, most: np.ndarray, above: bool) -> np.ndarray:
        """Of each test suffix, cut to ``most`` words, the first place of the array that is not less (or, above, greater)."""
        low, high = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(self.order))
        while (going := np.flatnonzero(low < high)).size:
            middle = (low[going] + high[going]) >> 1
            shared, less = self.common(tests, suffix[going], most[going], self.order[middle])
            up = less | (shared == most[going]) if above else less
            low[going[up]] = middle[up] + 1
            high[going[~up]] = middle[~up]
        return low

    def longest(self, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
        """Of each test suffix the words of its longest match in the shard, and a place of it."""
        every = np.arange(len(tests.start))
        best, where = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        if len(self.order):
            found = self.search(tests, every, tests.length, above=False)
            for side in (found - 1, found):
                at = self.order[np.clip(side, 0, len(self.order) - 1)]
                shared, _ = self.common(tests, every, tests.length, at)
                where = np.where(shared > best, at, where)
                best = np.maximum(best, shared)
        return best, where

    def windows(self, tests: TestSuffixes, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (suffix, place) at which the window that the suffix begins stands in the shard, equal windows told once."""
        suffix = np.flatnonzero((tests.window > 0) & (longest >= tests.window))
        low = self.search(tests, suffix, tests.window[suffix], above=False)
        high = self.search(tests, suffix, tests.window[suffix], above=True)
        return suffix, np.stack([low, high], axis=1)


def shards(texts: list[bytes], limit: int) -> Iterator[slice]:
    """Neighbouring texts of up to ``limit`` bytes; a longer text is a shard of its own."""
    begin = held = 0
    for i, raw in enumerate(texts):
        if held and held + len(raw) > limit:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(raw)
    if begin < len(texts):
        yield slice(begin, len(texts))


@dataclass
class Marks:
    """What is found in one document: its words, hit runs [begin, end) in words, and numbers of the items."""

    n_words: int
    runs: np.ndarray
    items: np.ndarray


def mark_shard(texts: list[bytes], tests: TestSuffixes) -> list[Marks]:
    shard = Shard.of(texts, tests)
    best, _ = shard.longest(tests)
    suffix, ranges = shard.windows(tests, best)
    found = [Marks(int(n), np.zeros((0, 2), np.int64), np.zeros(0, np.int64)) for n in shard.sizes]
    if not len(suffix):
        return found
    # Places of equal windows are listed once; all items of a range belong to its documents.
    distinct, which = np.unique(np.column_stack([ranges, tests.window[suffix]]), axis=0, return_inverse=True)
    count = distinct[:, 1] - distinct[:, 0]
    at = shard.order[np.repeat(distinct[:, 0], count) + ragged(count)]
    name = np.repeat(np.arange(len(distinct)), count)
    document, end = shard.document[at], shard.place[at] + np.repeat(distinct[:, 2], count)
    # Runs: windows of a document by their begin; a new run begins beyond all ends so far.
    begin = shard.place[at]
    by = np.lexsort((begin, document))
    document, begin, end, name = document[by], begin[by], end[by], name[by]
    base = document * (int(shard.sizes.max(initial=0)) + 1)
    reach = np.maximum.accumulate(end + base)
    new = np.concatenate(([True], (begin + base)[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(begin)])) - 1
    runs = np.column_stack([begin[first], reach[last] - base[last]])
    for d, own in groups(document[first]):
        found[d].runs = runs[own]
    # Items of each range once, then of each document once.
    pairs = np.unique(np.column_stack([which.ravel(), tests.item[suffix]]), axis=0)
    offset = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
    met = np.unique(np.column_stack([document, name]), axis=0)
    for d, own in groups(met[:, 0]):
        names = met[own, 1]
        found[d].items = np.unique(np.concatenate([pairs[offset[n] : offset[n + 1], 1] for n in names]))
    return found


def groups(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each key of a sorted array and the places that hold it."""
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else keys
    for a, b in zip(begins, [*begins[1:], len(keys)], strict=True):
        yield int(keys[a]), slice(a, b)


def item_block(rows: DataFrame, block: int, window: int) -> TestSuffixes:
    own = rows.where(F.col("block") == block).select("id", "text").collect()
    return TestSuffixes.of(sorted((r["id"], r["text"]) for r in own), window)


def over_shards(text_col: str, limit: int, make: Callable[[list[bytes]], list]):
    """What ``make`` gives for each text of a batch, shard by shard, beside the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        for batch in batches:
            texts = raw_texts(batch.column(batch.schema.get_field_index(text_col)))
            yield batch, [x for part in shards(texts, limit) for x in make(texts[part])]

    return run


def digest(ids: list[str]) -> str:
    """Of the sorted, distinct ids."""
    return sha256(",".join(sorted(set(ids))).encode("utf-8", "surrogatepass")).hexdigest()


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _batch(ids: pa.Array, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"items_sha256": pa.string(), "contaminated": pa.bool_(), "b": pa.list_(pa.int64()), "e": pa.list_(pa.int64()), "items": pa.list_(pa.string())}
    columns = [pa.array([r[i] for r in rows], kinds.get(n, pa.int64())) for i, n in enumerate(names)]
    return pa.RecordBatch.from_arrays([ids, *columns], ["id", *names])


def mark_contaminated(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    item_bytes: int = ITEM_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are maximal runs of letters and digits, all characters beyond ASCII among them, A-Z in lower case.  A
    window is ``window`` consecutive words of an item; an item of fewer is one window.  A word of a document
    inside any place of a window is hit; n_items counts the items of those windows, and items_sha256 is of
    their ids, sorted as strings and joined by commas.

    * A null or empty text has no words; an item of none has no window.
    * Rows that repeat an item's id are windows of that item; items without id take no part.
    * Every document row is one of its own, also where its id is null or repeats.
    * Empty tables of documents or items are read as such; other columns are ignored.
    * Texts of any length are read whole: a long one is a shard of its own.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    table, blocks = item_table(items, item_col, item_text_col, item_bytes)
    if blocks == 1:
        tests = item_block(table, 0, window)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, marks in over_shards("text", shard_bytes, lambda t: mark_shard(t, tests))(batches):
                out = [
                    (m.n_words, int((m.runs[:, 1] - m.runs[:, 0]).sum()), len(n := {tests.ids[i] for i in m.items}), digest(list(n)), bool(len(m.runs)))
                    for m in marks
                ]
                yield _batch(batch.column(0), out, ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

        return rows.mapInArrow(whole, f"id {kind}, {RESULT}").withColumnRenamed("id", id_col)

    # More blocks: every pass marks numbered documents, and the runs and ids of a document meet by its number.
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "documents")
    texts, schema = rows.select(F.col("row").alias("id"), "text"), "id long, n_words long, b array<long>, e array<long>, items array<string>"
    found = _union([materialize(texts.mapInArrow(_runs(item_block(table, n, window), shard_bytes), schema), "marks") for n in range(blocks)])
    sizes = found.groupBy("id").agg(F.max("n_words").alias("n_words"))
    runs = found.select("id", F.explode(F.arrays_zip("b", "e")).alias("run")).select("id", "run.*")
    before = Window.partitionBy("id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.col("e") - F.greatest(F.col("b"), F.coalesce(F.max("e").over(before), F.col("b"))), F.lit(0))
    hits = runs.withColumn("n", covered).groupBy("id").agg(F.sum("n").alias("n_hit"))
    named = found.where(F.size("items") > 0).select("id", F.explode("items").alias("item")).groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.select("row", F.col("id").alias("key")).join(sizes, F.col("row") == sizes["id"]).drop("id")
    out = out.join(hits, F.col("row") == hits["id"], "left").drop("id").join(named, F.col("row") == named["id"], "left").drop("id")
    return out.select(
        F.col("key").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("items").isNotNull().alias("contaminated"),
    )


def _runs(tests: TestSuffixes, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, marks in over_shards("text", shard_bytes, lambda t: mark_shard(t, tests))(batches):
            out = [(m.n_words, m.runs[:, 0].tolist(), m.runs[:, 1].tolist(), sorted({tests.ids[i] for i in m.items})) for m in marks]
            yield _batch(batch.column(0), out, ["n_words", "b", "e", "items"])

    return run


def _union(frames: list[DataFrame]) -> DataFrame:
    found = frames[0]
    for frame in frames[1:]:
        found = found.unionByName(frame)
    return found


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    item_bytes: int = ITEM_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The documents that hold no window of any item, with all their columns; see :func:`mark_contaminated`.

    With more items than one block holds, each pass removes what its block hits from what the last one left.
    """
    table, blocks = item_table(items, item_col, item_text_col, item_bytes)
    kept = docs
    for n in range(blocks):
        tests = item_block(table, n, window)

        def clean(batches: Iterator[pa.RecordBatch], tests: TestSuffixes = tests) -> Iterator[pa.RecordBatch]:
            for batch, marks in over_shards(text_col, shard_bytes, lambda t: mark_shard(t, tests))(batches):
                yield batch.filter(pa.array([not len(m.runs) for m in marks], pa.bool_()))

        kept = kept.mapInArrow(clean, docs.schema)
        if blocks > 1:
            kept = materialize(kept, "clean")
    return kept


def longest_matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    item_bytes: int = ITEM_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The longest verbatim match of every item suffix that has one of a window or more, and one place of it.

    (item_id string, item_word, words, doc_id, doc_word): from word ``item_word`` of the item on, ``words`` words
    stand from word ``doc_word`` of the document on.  Of equally long matches that of the smallest document id
    and word is told, of each shard one.  Documents without id take no part; see :func:`mark_contaminated`.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table, blocks = item_table(items, item_col, item_text_col, item_bytes)
    found = []
    for n in range(blocks):
        tests = item_block(table, n, window)

        def matches(batches: Iterator[pa.RecordBatch], tests: TestSuffixes = tests) -> Iterator[pa.RecordBatch]:
            begin = tests.start - np.concatenate(([0], np.cumsum(np.bincount(tests.item, minlength=len(tests.ids)))))[tests.item]
            for batch in batches:
                texts, ids = raw_texts(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
                for part in shards(texts, shard_bytes):
                    shard = Shard.of(texts[part], tests)
                    best, where = shard.longest(tests)
                    told = np.flatnonzero((best >= tests.window) & (tests.window > 0))
                    at = where[told]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([tests.ids[i] for i in tests.item[told]], pa.string()),
                            pa.array(begin[told], pa.int64()),
                            pa.array(best[told], pa.int64()),
                            pa.array(ids[part][shard.document[at]], pa.int64()),
                            pa.array(shard.place[at], pa.int64()),
                        ],
                        ["item_id", "item_word", "words", "doc_id", "doc_word"],
                    )

        own = rows.mapInArrow(matches, "item_id string, item_word long, words long, doc_id long, doc_word long")
        found.append(materialize(own, "matches") if blocks > 1 else own)
    best = F.min(F.struct(-F.col("words"), "doc_id", "doc_word")).alias("best")
    ranked = _union(found).groupBy("item_id", "item_word").agg(best)
    return ranked.select("item_id", "item_word", (-F.col("best.col1")).alias("words"), "best.doc_id", "best.doc_word")


__all__ = ["decontaminate", "longest_matches", "mark_contaminated"]
