"""Annotations and configured exemptions as tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorewatch import values as V
from shorewatch.functions import exemptions as ex
from shorewatch.functions import text
from shorewatch.functions.globs import GlobTree
from shorewatch.operators.salting import salted_join
from shorewatch.operators.tables import written
from shorewatch.sources.rules import MAX_BROADCAST_BYTES


def annotations(files: DataFrame) -> DataFrame:
    """Accepted annotations: ``(source, file, line, target_line, rule_id, reason, until)``.

    The target is the next non-blank line.  Only files containing the marker are split; of those the lines that
    are not blank are numbered in one pass, and an annotation's target is the next of them.
    """
    kept = F.transform("lines", lambda line, i: F.struct(i.alias("pos"), line.alias("text")))
    return (
        files.where(F.contains("content", F.lit(V.MARKER)))
        .withColumn("lines", text.lines(F.col("content")))
        .withColumn("kept", F.filter(kept, lambda x: ~text.is_blank(x["text"])))
        .select("source", "file", "kept", F.posexplode_outer("kept").alias("nth", "own"))
        .where(ex.has_marker(F.col("own.text")))
        .select(
            "source",
            "file",
            (F.col("own.pos") + 1).alias("line"),
            (F.get("kept", F.col("nth") + 1)["pos"] + 1).alias("target_line"),
            F.col("own.text").alias("text"),
        )
        .where(F.col("target_line").isNotNull())
        .withColumn("note", ex.annotation(F.col("text")))
        .where(F.col("note").isNotNull())
        .select("source", "file", "line", "target_line", F.col("note.rule").alias("rule_id"), "note.reason", "note.until")
    )


def apply_annotations(findings: DataFrame, notes: DataFrame, as_of: Column) -> DataFrame:
    """Join form for findings and annotations kept as tables; at most one annotation per line."""
    n = notes.select(
        F.col("source").alias("n_source"),
        F.col("file").alias("n_file"),
        F.col("target_line"),
        F.col("rule_id").alias("n_rule"),
        F.col("reason").alias("n_reason"),
        F.col("until").alias("n_until"),
    )
    joined = findings.join(
        n,
        (F.col("source") == F.col("n_source"))
        & (F.col("file") == F.col("n_file"))
        & (F.col("line") == F.col("target_line"))
        & ((F.col("n_rule") == "") | (F.col("n_rule") == F.col("rule_id"))),
        "left",
    )
    hit = F.col("n_reason").isNotNull()
    exemption = F.when(
        hit, ex.exemption(F.col("n_reason"), F.lit(""), F.col("n_until"), "inline")
    ).otherwise(F.col("exemption"))
    status = F.when(hit, ex.exempted_status(F.col("n_until"), as_of)).otherwise(F.col("status"))
    return joined.withColumns({"exemption": exemption, "status": status}).select(*findings.columns)


ENTRY = "array<struct<ord: int, rule: string, reason: string, owner: string, until: string>>"
_ENTRY_FIELDS = ("ord", "rule", "path", "reason", "owner", "until")
#: Files of a source that one task compares with its list at once.
FILES_AT_ONCE = 50_000
#: Entries of a list, and stars of a glob in it, up to which the list goes with the findings and needs no tree.
SHORT, STARS = 16, 4
#: A joined list lies once in an executor, without Python objects, where collected ones lie in every Python worker.
JOINED = 8


def valid_exemptions(exemptions: DataFrame) -> DataFrame:
    """Entries of all sources whose every entry has a reason; a blank one voids the whole list of its source."""
    blank = F.coalesce(text.is_blank(F.col("reason")), F.lit(True))
    void = exemptions.where(blank).select("source").distinct()
    kept = exemptions.join(void, "source", "left_anti")
    return kept.select("source", "ord", *[F.coalesce(c, F.lit("")).alias(c) for c in ("rule", "path")], "reason", "owner", "until")


class ExemptionList:
    """Entries of one source in their order, and which of them can decide about the findings of a file."""

    def __init__(self, rows: Iterable[tuple]):
        rows = sorted(rows, key=lambda r: r[0])
        self.tree = GlobTree([r[2] for r in rows])
        self.entries = [dict(zip(("ord", "rule", "reason", "owner", "until"), (r[0], r[1], *r[3:]), strict=True)) for r in rows]

    def deciding(self, file: str) -> list[dict]:
        """Entries that match the path: of each rule the first, and none behind the first for all rules."""
        found, rules = [], set()
        for n in self.tree.match(file):
            entry = self.entries[n]
            if entry["rule"] not in rules:
                rules.add(entry["rule"])
                found.append(entry)
                if not entry["rule"]:
                    break
        return found


def _looked_up(lists: dict[str, list[tuple]]):
    """Deciding entries by source and file, for lists that every task can hold; a file is compared once a batch."""
    built: dict[str, ExemptionList] = {}

    def look(sources, files):
        import pandas as pd

        seen: dict[tuple, list[dict] | None] = {}
        for key in zip(sources, files, strict=True):
            if key not in seen:
                source, file = key
                if source in lists and source not in built:
                    built[source] = ExemptionList(lists[source])
                seen[key] = (built[source].deciding(file) or None) if file is not None and source in lists else None
        return pd.Series([seen[key] for key in zip(sources, files, strict=True)], dtype=object)

    return F.pandas_udf(look, ENTRY, F.PandasUDFType.SCALAR)


def _matched(key, files, entries):
    import pandas as pd

    own = ExemptionList(entries[list(_ENTRY_FIELDS)].itertuples(index=False, name=None))
    found = [(source, file, own.deciding(file)) for source, file in zip(files["source"], files["file"], strict=True)]
    return pd.DataFrame([f for f in found if f[2]], columns=["source", "file", "listed"])


def matched_entries(files: DataFrame, entries: DataFrame, at_once: int = FILES_AT_ONCE) -> DataFrame:
    """(source, file, listed) of the distinct files that entries of their source match.

    The files of a source are dealt to as many tasks as their count asks for, each with the source's list.
    """
    files = written(files.join(entries.select("source").distinct(), "source", "left_semi").distinct(), "files")
    parts = files.groupBy("source").agg(F.ceil(F.count("*") / at_once).cast("int").alias("parts"))
    parts = written(parts, "parts")
    dealt = files.join(parts, "source").withColumn("part", F.pmod(F.xxhash64("file"), F.col("parts")).cast("int")).drop("parts")
    copies = entries.join(parts, "source").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.groupBy("source", "part").cogroup(copies.groupBy("source", "part")).applyInPandas(_matched, f"source string, file string, listed {ENTRY}")


def _compared(findings: DataFrame, entries: DataFrame, small: bool) -> DataFrame:
    """Findings with ``_pick``, the entry of their source's short list that decides about an active one."""
    # What a path must begin with; a slash before ** may be absent.
    head = F.regexp_replace(F.regexp_extract("path", r"\A[^*?]*", 0), r"/\z", "")
    # The longest text without a wildcard or slash is in every path that matches; the pattern, compiled anew for each entry, seldom runs.
    runs = F.regexp_extract_all("path", F.lit(r"[^*?/]+"), F.lit(0))
    longest = F.aggregate(runs, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    entry = F.struct("ord", "rule", head.alias("head"), longest.alias("held"), ex.glob_regex(F.col("path")).alias("rx"), "reason", "owner", "until")
    lists = entries.groupBy("source").agg(F.array_sort(F.collect_list(entry)).alias("_list"))
    if small:
        own = F.broadcast(lists.withColumnRenamed("source", "_source"))
        joined = findings.join(own, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    else:
        joined = salted_join(findings, lists, ["source"], how="left", max_bytes=0)
    matches = "startswith(file, e.head) AND contains(file, e.held) AND rlike(concat('/', file), e.rx)"
    first = F.expr(f"get(filter(_list, e -> (e.rule = '' OR e.rule = rule_id) AND {matches}), 0)")
    picked = F.when((F.col("status") == V.ACTIVE) & F.col("_list").isNotNull(), first)
    return joined.withColumn("_pick", picked).select(*findings.columns, "_pick")


def _walked(findings: DataFrame, entries: DataFrame, total: int, collect_bytes: int, at_once: int) -> DataFrame:
    """Adds ``_listed``, the entries of long lists that can decide about the file of an active finding."""
    active = F.col("status") == V.ACTIVE
    if total <= collect_bytes:
        lists: dict[str, list[tuple]] = {}
        for row in entries.select("source", *_ENTRY_FIELDS).collect():
            lists.setdefault(row["source"], []).append(tuple(row)[1:])
        return findings.withColumn("_listed", _looked_up(lists)("source", F.when(active, F.col("file"))))
    if findings.isStreaming:
        raise ValueError("lists of this size need a job for each batch of the stream")
    findings = written(findings, "findings")
    listed = matched_entries(findings.where(active).select("source", "file"), entries, at_once)
    return findings.join(listed.withColumnRenamed("listed", "_listed"), ["source", "file"], "left")


def apply_config(
    findings: DataFrame,
    exemptions: DataFrame,
    as_of: Column,
    collect_bytes: int = MAX_BROADCAST_BYTES,
    at_once: int = FILES_AT_ONCE,
) -> DataFrame:
    """First matching entry of the source's list decides; annotated findings stay as they are.

    Short lists are joined by source, one row a source, and their globs compared where the finding is; what a task
    does then depends on its own findings, not on the number of lists.  Up to ``JOINED`` times ``collect_bytes`` they
    are broadcast, larger ones meet the salted findings.  Long lists are trees that a path walks once: those whose
    counted size is at most ``collect_bytes`` go to every task; larger ones meet the distinct files of their sources
    in tasks of bounded size (see :func:`matched_entries`), and findings are joined by file, so no source is too large.
    """
    entries = written(valid_exemptions(exemptions), "entries")
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c in ("source", *_ENTRY_FIELDS[1:])), F.lit(32))
    stars = F.length("path") - F.length(F.replace("path", F.lit("*"), F.lit("")))
    shapes = entries.groupBy("source").agg(F.count("*").alias("n"), F.max(stars).alias("stars"), F.sum(size).alias("bytes"))
    shapes = shapes.withColumn("short", (F.col("n") <= SHORT) & (F.col("stars") <= STARS))
    totals = {r["short"]: r["bytes"] for r in shapes.groupBy("short").agg(F.sum("bytes").alias("bytes")).collect()}
    long = shapes.where("NOT short").select(F.col("source").alias("_long"))
    same = F.col("source").eqNullSafe(F.col("_long"))
    columns, picks = findings.columns, []
    if True in totals:
        short = entries.join(long, same, "left_anti") if False in totals else entries
        findings = _compared(findings, short, totals[True] <= JOINED * collect_bytes)
        picks.append(F.col("_pick"))
    if False in totals:
        walked = entries.join(long, same, "left_semi")
        findings = _walked(findings, walked, totals[False], collect_bytes, at_once)
        fits = F.expr("get(filter(_listed, e -> e.rule = '' OR e.rule = rule_id), 0)")
        picks.append(F.when(F.col("status") == V.ACTIVE, fits))
    if not picks:
        return findings
    kept = [F.struct(*[p[n].alias(n) for n in ("reason", "owner", "until")]) for p in picks]
    chosen = F.coalesce(*[F.when(p.isNotNull(), k) for p, k in zip(picks, kept, strict=True)])
    # A column that names its task is not copied into filters, so no entry is looked up again wherever a filter asks for the
    # status made of it; where nobody reads what is made of it, it is left out.
    picked = findings.withColumn("pick", F.when(F.spark_partition_id() >= 0, chosen))
    hit = F.col("pick").isNotNull()
    exemption = F.when(
        hit, ex.exemption(F.col("pick.reason"), F.col("pick.owner"), F.col("pick.until"), "config")
    ).otherwise(F.col("exemption"))
    status = F.when(hit, ex.exempted_status(F.col("pick.until"), as_of)).otherwise(F.col("status"))
    return picked.withColumns({"exemption": exemption, "status": status}).select(*columns)
