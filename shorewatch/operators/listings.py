"""Ordered listings and top-k tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shorewatch import values as V
from shorewatch.functions import labels, sarif, text
from shorewatch.functions import severity as sev
from shorewatch.operators.positions import numbered
from shorewatch.operators.rollup import severity_counts


def active(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("status") == V.ACTIVE)


#: Columns of findings that file listings and the views made of them read.
LISTED_COLUMNS = ["source", "file", "rule_ord", "rule_id", "line", "severity", "algorithm", "status"]


def report_order():
    """Position of a finding inside its report: directory walk, rule order, line."""
    return [text.segments(F.col("file")), F.col("rule_ord"), F.col("line")]


def algorithm_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """Active findings per algorithm, overall or per ``keys``; unnamed algorithms do not count."""
    named = active(findings).where(F.coalesce(F.col("algorithm"), F.lit("")) != "")
    return named.groupBy(*keys, "algorithm").agg(F.count("*").alias("count"))


def top_algorithms(findings: DataFrame, k: int = 10) -> DataFrame:
    return algorithm_counts(findings).orderBy(F.desc("count"), "algorithm").limit(k)


def top_algorithms_by_source(findings: DataFrame, k: int = 10) -> DataFrame:
    """Per source, with the bar length relative to the most frequent one.

    The windows run over counted algorithms, not over findings.
    """
    ranked = Window.partitionBy("source").orderBy(F.desc("count"), "algorithm")
    whole = Window.partitionBy("source")
    return (
        algorithm_counts(findings, "source")
        .withColumns({"position": F.row_number().over(ranked), "largest": F.max("count").over(whole)})
        .where(F.col("position") <= k)
        .select(
            "source",
            "position",
            "algorithm",
            "count",
            sev.bar_percent(F.col("count"), F.col("largest")).alias("bar_pct"),
        )
    )


def top_algorithm(findings: DataFrame, reports: DataFrame) -> DataFrame:
    """Most frequent algorithm of each report, ``n/a`` without active named findings."""
    best = (
        algorithm_counts(findings, "source")
        .groupBy("source")
        .agg(F.min(F.struct((-F.col("count")).alias("order"), "algorithm")).alias("best"))
        .select("source", F.col("best.algorithm").alias("top_algorithm"))
    )
    return reports.join(best, "source", "left").withColumn(
        "top_algorithm", F.coalesce("top_algorithm", F.lit(V.NO_ALGORITHM))
    )


def file_groups(findings: DataFrame) -> DataFrame:
    """Active severity counts per file; order with :func:`file_group_order`."""
    return (
        active(findings)
        .groupBy("source", "file")
        .agg(
            *severity_counts(["critical", "high", "medium", "low"], F.lit(True)),
            F.count("*").alias("findings"),
        )
        .withColumn("short", text.short_path(F.col("file")))
    )


def file_group_order():
    return [F.desc("critical"), F.desc("high"), F.asc("file")]


def placed_file_groups(findings: DataFrame) -> DataFrame:
    """File groups with their ``position`` in the source's listing, from 1; a source may have any number of files."""
    return numbered(file_groups(findings), ["source"], file_group_order(), "position")


def file_listing(findings: DataFrame) -> DataFrame:
    """Active findings below their files: the file's ``position`` in its source, the finding's ``nth`` in the file.

    The findings of a file are numbered in a window; those are bounded by the file, and a source's files are not.
    """
    groups = placed_file_groups(findings).select("source", "file", "short", "position")
    order = Window.partitionBy("source", "file").orderBy("rule_ord", "line")
    own = active(findings).withColumn("nth", F.row_number().over(order))
    return own.join(groups, ["source", "file"])


def view_model(findings: DataFrame, reports: DataFrame) -> DataFrame:
    """All rows of the report views: (source, section, position, nth, name, detail, count, bar).

    Sections are ``total`` (active findings; in bar the count of the most frequent algorithm, at least 1),
    ``algorithm`` (the ten most frequent, with their bars), ``file`` (severity counts as detail) and ``finding`` (in
    the place of its file, with severity, algorithm and line).  Written in the order of source, section, position
    and nth they are the view; none is nested, so no source is too large.
    """
    zero = F.lit(0)
    named = {c: F.col(c) for c in ("source", "section", "position", "nth", "name", "detail", "count", "bar")}

    def rows(frame: DataFrame, section: str, **columns: Column) -> DataFrame:
        found = {"section": F.lit(section), "nth": zero, "position": zero, "detail": F.lit(""), "bar": zero} | columns
        numbers = ("position", "nth", "count", "bar")
        return frame.select(*[(found.get(n, c).cast("bigint") if n in numbers else found.get(n, c)).alias(n) for n, c in named.items()])

    most = algorithm_counts(findings, "source").groupBy("source").agg(F.max("count").alias("largest"))
    totals = reports.select("source", "active").join(most, "source", "left")
    counts = F.concat_ws("/", *[F.col(c).cast("string") for c in ("critical", "high", "medium", "low")])
    told = F.concat_ws(":", "severity", "algorithm", F.col("line").cast("string"))
    parts = [
        rows(totals, "total", name=F.lit("active"), count=F.col("active"), bar=F.coalesce("largest", F.lit(1))),
        rows(top_algorithms_by_source(findings), "algorithm", position=F.col("position"), name=F.col("algorithm"), bar=F.col("bar_pct")),
        rows(placed_file_groups(findings), "file", position=F.col("position"), name=F.col("short"), detail=counts, count=F.col("findings")),
        rows(file_listing(findings), "finding", position=F.col("position"), nth=F.col("nth"), name=F.col("rule_id"), detail=told, count=F.lit(1)),
    ]
    return reduce(DataFrame.unionByName, parts)


def top_findings(findings: DataFrame, k: int) -> DataFrame:
    """The ``k`` most severe active findings of all sources."""
    return (
        active(findings)
        .orderBy(
            sev.listing_rank(F.col("severity")), text.slug(F.col("source")), F.col("source"), *report_order()
        )
        .limit(k)
    )


def top_findings_by_source(findings: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most severe active findings of each source.

    The rank filter is applied per task before the shuffle, so a dominant source
    sends at most ``k`` rows per task.
    """
    order = Window.partitionBy("source").orderBy(sev.listing_rank(F.col("severity")), *report_order())
    return active(findings).withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def project_page(findings: DataFrame) -> DataFrame:
    """Rows of a project page."""
    return active(findings).select(
        "source",
        F.lower("severity").alias("severity_class"),
        "severity",
        "algorithm",
        text.short_path(F.col("file")).alias("short_file"),
        "file",
        "line",
        "quantum_threat",
        labels.threat_label(F.col("quantum_threat")).alias("threat_label"),
        "message",
    )


def ci_lines(findings: DataFrame) -> DataFrame:
    """Build-log annotations; exempted findings are shown as well."""
    return findings.select(
        "source",
        "file",
        "line",
        "rule_id",
        sev.ci_level(F.col("severity")).alias("level"),
        F.format_string(
            "::%s file=%s,line=%d::[%s] %s",
            sev.ci_level(F.col("severity")),
            "file",
            "line",
            "algorithm",
            "message",
        ).alias("text"),
    )


def step_summary(reports: DataFrame) -> DataFrame:
    """Eight metrics per report, one row each."""
    # Labels of the table's rows.
    metrics = [
        ("Files scanned", "files_scanned"),
        ("Total findings", "total"),
        ("Critical", "critical"),
        ("High", "high"),
        ("NIS2", "nis2"),
        ("DORA", "dora"),
        ("NIST FIPS 203", "nist_fips_203"),
        ("NIST FIPS 204", "nist_fips_204"),
    ]
    rows = [part for i, (m, c) in enumerate(metrics) for part in (F.lit(i), F.lit(m), F.col(c).cast("string"))]
    return reports.select("source", F.stack(F.lit(len(metrics)), *rows).alias("ord", "metric", "value"))


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn(
        "fingerprint", sarif.fingerprint(F.col("rule_id"), F.col("file"), F.col("snippet"))
    )


def rule_firsts(findings: DataFrame) -> DataFrame:
    """Distinct rules of each report, described by their first finding, with its place as ``first`` and their index.

    The index window runs over distinct rules only.
    """
    place = F.struct(text.segments(F.col("file")).alias("segs"), "rule_ord", "line")
    described = F.struct(
        "algorithm", "severity", "message", "migration", "quantum_threat", "primitive", "composition"
    )
    first = findings.groupBy("source", "rule_id").agg(
        F.min(place).alias("first"), F.min_by(described, place).alias("described")
    )
    index = F.row_number().over(Window.partitionBy("source").orderBy("first")) - 1
    return first.select("source", "rule_id", index.alias("rule_index"), "described.*", "first")


def report_rules(findings: DataFrame) -> DataFrame:
    """The rules of :func:`rule_firsts` without the place."""
    return rule_firsts(findings).drop("first")
