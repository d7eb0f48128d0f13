"""Exact removal of repeated byte strings.

Every string of the given length picks one anchor, the least hash of the short grams it holds, so equal
strings pick equal anchors at equal places.  A document is thus cut into fragments, one per anchor,
whose strings can only repeat in fragments of the same anchor.  Fragments that are equal as a whole are
settled by counting.  Distinct fragments of an anchor are gathered, many anchors to a task, and what
they have in common is found by interval expansion on a Burrows-Wheeler transform; anchors with more
fragments than a task should hold exchange packed hashes of their strings instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorewatch.llm.common import materialize
from shorewatch.llm.repeats import repeated_starts
from shorewatch.llm.shingles import mixed

#: Bytes of an anchor's gram; distinct fragments that one task looks at; bytes of a text hashed at once.
GRAM, FRAGMENTS, STRETCH = 128, 1500, 1 << 22
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


class Rolling:
    """Hashes of all substrings of a stretch of bytes, from sums of powers."""

    def __init__(self, raw: np.ndarray, root: np.uint64):
        self.powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(raw), root, np.uint64))))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((mixed(raw.astype(np.uint64) + root)) * self.powers[:-1])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), the same wherever the bytes stand: all are moved to the end of the stretch."""
        last = len(self.powers) - 1
        return mixed((self.sums[end] - self.sums[start]) * self.powers[last - start] * self.scale(last))

    def scale(self, last: int) -> np.uint64:
        # One power for every stretch, so that hashes of different stretches compare.
        return np.uint64(pow(int(self.powers[1]) if last else 1, STRETCH * 2 - last, 1 << 64))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from least values so far in blocks, forwards and backwards."""
    n = len(values) - width + 1
    padded = np.concatenate((values, np.full(-len(values) % width, np.iinfo(np.int64).max)))
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def fragments(raw: bytes, length: int, gram: int) -> list[np.ndarray]:
    """Of each fragment: anchor, two hashes of its bytes, first start, number of starts.

    Starts from ``low`` to ``low + count - 1`` pick the anchor; the fragment's bytes are those that
    their strings cover.  The first hash is of the bytes together with where the anchor is in them.
    """
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    width, total = length - gram + 1, len(raw) - length + 1
    for begin in range(0, max(0, total), STRETCH):
        data = np.frombuffer(raw, np.uint8, offset=begin, count=min(STRETCH + length - 1, len(raw) - begin))
        one, two = Rolling(data, _ROOT), Rolling(data, _OTHER)
        at = np.arange(len(data) - gram + 1)
        hashes = one.of(at, at + gram)
        # Ties go to the first place: the low bits hold it.
        ranked = ((hashes >> np.uint64(25)) << np.uint64(24)).astype(np.int64) | at
        chosen = sliding_least(ranked, width) & ((1 << 24) - 1)
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        count = np.diff(np.concatenate((first, [len(chosen)])))
        anchor, end = chosen[first], first + count + length - 1
        together = mixed(one.of(first, end) + (anchor - first).astype(np.uint64) * _OTHER + count.astype(np.uint64))
        for part, new in zip(parts, (hashes[anchor], together, two.of(first, end), first + begin, count), strict=True):
            part.append(new)
    return [np.concatenate(p).astype(np.int64) if p else np.zeros(0, np.int64) for p in parts]


def encode(text: object) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def cut(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [fragments(encode(t), length, gram) for t in batch["text"]]
            yield pd.DataFrame(
                {"h1": batch["h1"], "h2": batch["h2"]} | {c: [f[i] for f in found] for i, c in enumerate(["anchor", "f1", "f2", "low", "count"])}
            )

    return run


def take_bytes(length: int):
    """The bytes of wanted fragments of a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
                raw = encode(text)
                rows += [(w["anchor"], w["f1"], w["f2"], w["hot"], raw[w["low"] : w["low"] + w["count"] + length - 1]) for w in wanted]
            yield pd.DataFrame(rows, columns=["anchor", "f1", "f2", "hot", "bytes"])

    return run


def expand(length: int):
    """Starts that repeat among the fragments of a group of anchors."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["anchor", "f1", "f2"])
        found = repeated_starts(rows["bytes"].tolist(), length)
        out = pd.DataFrame({"anchor": rows["anchor"], "f1": rows["f1"], "f2": rows["f2"], "starts": found})
        return out[[len(x) > 0 for x in found]]

    return run


def hash_strings(length: int, parts: int):
    """String hashes of hot fragments, packed by the part of hash space that they belong to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            one, two, owner, start = [], [], [], []
            for i, raw in enumerate(batch["bytes"]):
                data = np.frombuffer(raw, np.uint8)
                at = np.arange(len(data) - length + 1)
                one.append(Rolling(data, _ROOT).of(at, at + length))
                two.append(Rolling(data, _OTHER).of(at, at + length))
                owner.append(np.full(len(at), i))
                start.append(at)
            if not one:
                continue
            one, two, owner, start = (np.concatenate(x) for x in (one, two, owner, start))
            part = (one % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            names, begins = np.unique(part[order], return_index=True)
            pieces = [np.split(x[order], begins[1:]) for x in (one.view(np.int64), two.view(np.int64), owner, start)]
            # Names of the fragments go along once for each packet.
            keys = [batch[c].to_numpy() for c in ("anchor", "f1", "f2")]
            rows = []
            for n, (p1, p2, o, s) in zip(names, zip(*pieces, strict=True), strict=True):
                used, local = np.unique(o, return_inverse=True)
                rows.append((n, p1, p2, local.astype(np.int32), s.astype(np.int32), *(k[used] for k in keys)))
            yield pd.DataFrame(rows, columns=["part", "s1", "s2", "owner", "start", "anchor", "f1", "f2"])

    return run


def match_strings(rows: pd.DataFrame) -> pd.DataFrame:
    """Starts of a part of hash space whose strings come more than once."""
    s1, s2 = np.concatenate(rows["s1"].tolist()), np.concatenate(rows["s2"].tolist())
    names = np.array([(a, b, c) for x in zip(rows["anchor"], rows["f1"], rows["f2"], strict=True) for a, b, c in zip(*x, strict=True)])
    sizes = np.array([len(x) for x in rows["anchor"]])
    shift = np.repeat(np.cumsum(sizes) - sizes, [len(x) for x in rows["owner"]])
    owner, start = np.concatenate(rows["owner"].tolist()) + shift, np.concatenate(rows["start"].tolist())
    # A fragment comes once, so equal strings are of different fragments.
    _, group, times = np.unique(np.stack([s1, s2]), axis=1, return_inverse=True, return_counts=True)
    often = times[group.ravel()] > 1
    order = np.argsort(owner[often], kind="stable")
    at, begins = np.unique(owner[often][order], return_index=True)
    starts = np.empty(len(at), object)
    starts[:] = np.split(start[often][order], begins[1:]) if len(at) else []
    names = names.reshape(-1, 3)[at]
    return pd.DataFrame({"anchor": names[:, 0], "f1": names[:, 1], "f2": names[:, 2], "starts": starts})


def covered(starts: np.ndarray, length: int) -> np.ndarray:
    """Rows [begin, end) of the runs of bytes that strings at the starts cover."""
    starts = np.unique(starts)
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    # Strings that touch make one run of removed bytes.
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > starts[:-1] + length)))
    return np.stack([starts[new], starts[np.concatenate((new[1:], [len(starts)])) - 1] + length], axis=1)


def remove(length: int, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, whole, ranges in zip(batch["id"], batch["text"], batch["whole"], batch["ranges"], strict=True):
                raw = encode(text)
                runs = np.zeros((0, 2), np.int64)
                if whole and len(raw) >= length:
                    runs = np.array([[0, len(raw)]])
                elif ranges is not None:
                    runs = covered(np.concatenate([r["low"] + np.asarray(r["starts"], np.int64) if r["starts"] is not None else np.arange(r["low"], r["low"] + r["count"]) for r in ranges]), length)
                edges = [0, *runs.ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                row = (key, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept) if with_text else row)
            out = pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)
            out["id"] = out["id"].astype("Int64")
            yield out

    return run


def remove_repeats(
    docs: DataFrame,
    length: int = 400,
    id_col: str = "doc_id",
    text_col: str = "text",
    gram: int = GRAM,
    fragments_at_once: int = FRAGMENTS,
    with_kept: bool = False,
) -> DataFrame:
    """Removes every byte that a string of ``length`` bytes covers which also starts anywhere else.

    Texts are UTF-8 bytes; strings never cross texts and are judged on the input, so all copies go.
    Returns one row per input row: id, n_bytes, n_removed, n_spans (runs removed), kept_sha256 and, if
    asked for, the kept bytes.

    * A null text is empty; texts shorter than ``length`` lose nothing.
    * Every row is a text of its own, also where its id is null or repeats: equal rows lose everything
      from ``length`` bytes on.
    * An empty table gives an empty result; other columns are ignored.
    """
    if not 0 < gram <= length < STRETCH:
        raise ValueError("grams are no longer than the strings")
    content = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), content.alias("text"), F.xxhash64(content).alias("h1"), F.xxhash64(F.lit(7), content).alias("h2")
    )
    long_enough = F.octet_length("text") >= length
    schema = "h1 long, h2 long, anchor array<long>, f1 array<long>, f2 array<long>, low array<long>, count array<long>"
    every = rows.where(long_enough).select("h1", "h2", "text").mapInPandas(cut(length, gram), schema)
    # One entry for each text, however many rows have it.
    zipped = F.arrays_zip("anchor", "f1", "f2", "low", "count").alias("cut")
    texts = every.select("h1", "h2", zipped).groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.first("cut").alias("cut"))
    texts = materialize(texts, "texts")
    pieces = texts.select("h1", "h2", F.explode("cut").alias("c")).select("h1", "h2", "c.*")
    equal = materialize(pieces.groupBy("anchor", "f1", "f2").agg(F.count("*").alias("times"), F.min(F.struct("h1", "h2", "low", "count")).alias("one")), "equal")
    anchors = equal.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    anchors = materialize(anchors, "anchors")
    open_ = equal.join(anchors, "anchor").select("anchor", "f1", "f2", "one.*", (F.col("kinds") > fragments_at_once).alias("hot"))
    wanted = open_.groupBy("h1", "h2").agg(F.collect_list(F.struct("anchor", "f1", "f2", "low", "count", "hot")).alias("wanted"))
    wanted = materialize(wanted, "wanted")
    # Of rows with the same text one is enough; more give the same fragments again, and those are dropped.
    taken = materialize(
        rows.join(wanted, ["h1", "h2"]).select("text", "wanted").mapInPandas(take_bytes(length), "anchor long, f1 long, f2 long, hot boolean, bytes binary"),
        "taken",
    )
    cold, hot = taken.where("NOT hot"), taken.where("hot").dropDuplicates(["anchor", "f1", "f2"])
    totals = {r["hot"]: r["count"] for r in taken.groupBy("hot").count().collect()}
    groups = max(1, ceil(totals.get(False, 0) / fragments_at_once))
    starts = "anchor long, f1 long, f2 long, starts array<long>"
    group = F.pmod(F.xxhash64("anchor"), F.lit(groups))
    found = cold.groupBy(group).applyInPandas(expand(length), starts)
    if totals.get(True):
        parts = max(1, ceil(totals[True] / fragments_at_once))
        packet = "part long, s1 array<long>, s2 array<long>, owner array<int>, start array<int>, anchor array<long>, f1 array<long>, f2 array<long>"
        found = found.unionByName(hot.mapInPandas(hash_strings(length, parts), packet).groupBy("part").applyInPandas(match_strings, starts))
        found = found.groupBy("anchor", "f1", "f2").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    found = materialize(found, "found")
    # A fragment that comes twice repeats from end to end.
    settled = equal.join(found, ["anchor", "f1", "f2"], "left").where("times > 1 OR starts IS NOT NULL")
    settled = materialize(settled.select("anchor", "f1", "f2", F.when(F.col("times") == 1, F.col("starts")).alias("starts")), "settled")
    per_text = (
        pieces.join(settled, ["anchor", "f1", "f2"])
        .groupBy("h1", "h2")
        .agg(F.collect_list(F.struct("low", "count", "starts")).alias("ranges"))
    )
    verdict = texts.select("h1", "h2", (F.col("copies") > 1).alias("whole")).join(per_text, ["h1", "h2"], "left")
    verdict = materialize(verdict.where("whole OR ranges IS NOT NULL"), "verdict")
    marked = rows.join(verdict, ["h1", "h2"], "left").select("id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "ranges")
    kept = ", kept binary" if with_kept else ""
    out = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + kept
    return marked.mapInPandas(remove(length, with_kept), out).withColumnRenamed("id", id_col)


__all__ = ["covered", "fragments", "remove_repeats"]
