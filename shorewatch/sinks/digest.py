"""Combined multi-repository output: JSON fragments and Markdown table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorewatch.functions import text
from shorewatch.functions.severity import listing_rank
from shorewatch.operators import listings, portfolio
from shorewatch.sinks.documents import iso_utc


def _rows(frame: DataFrame, order: list, *cells) -> DataFrame:
    """``| a | b |`` text with an ordering key; cells are columns or column names."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cells]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[p.cast("string") for p in parts]), F.lit(" |"))
    return frame.select(F.struct(*order).alias("place"), line.alias("row"))


def overview(reports: DataFrame) -> DataFrame:
    # Labels of the table's rows.
    names = {
        "Projects scanned": "projects_count",
        "Total files scanned": "files_scanned",
        "Total findings": "total_findings",
        "Critical": "critical",
        "High": "high",
        "Medium": "medium",
        "Low": "low",
    }
    pairs = [p for i, (label, c) in enumerate(names.items()) for p in (F.lit(i), F.lit(label), F.col(c))]
    table = portfolio.global_totals(reports).select(F.stack(F.lit(len(names)), *pairs).alias("ord", "metric", "value"))
    return _rows(table, ["ord"], "metric", "value")


def compliance(reports: DataFrame) -> DataFrame:
    title = F.when(F.col("framework") == "NIS2", "NIS2 (Article 21)").otherwise("DORA (Article 9)")
    counts = portfolio.compliance_counts(reports)
    place = F.when(F.col("framework") == "NIS2", 0).otherwise(1).alias("ord")
    return _rows(counts, [place], title, "non_compliant", "at_risk", "compliant")


def algorithms(findings: DataFrame, k: int = 10) -> DataFrame:
    return _rows(listings.top_algorithms(findings, k), [-F.col("count"), "algorithm"], "algorithm", "count")


def threats(reports: DataFrame) -> DataFrame:
    merged = portfolio.merged_counts(reports, "by_quantum_threat", "threat")
    return _rows(merged, [-F.col("findings"), "threat"], "threat", "findings")


def projects(findings: DataFrame, reports: DataFrame) -> DataFrame:
    return _rows(
        listings.top_algorithm(findings, reports),
        [text.slug(F.col("source")), "source"],
        "source",
        "files_scanned",
        "critical",
        "high",
        "medium",
        "low",
        "total",
        "top_algorithm",
        "nis2",
        "dora",
    )


def worst_findings(findings: DataFrame, k: int = 10) -> DataFrame:
    quoted = F.concat(F.lit("`"), text.base_name(F.col("file")), F.lit("`"))
    order = [listing_rank(F.col("severity")), text.slug(F.col("source")), "source", *listings.report_order()]
    named = [c.alias(f"k{i}") if isinstance(c, Column) else F.col(c).alias(f"k{i}") for i, c in enumerate(order)]
    return _rows(
        listings.top_findings(findings, k),
        named,
        "source",
        quoted,
        "line",
        "algorithm",
        "severity",
        "quantum_threat",
    )


def project_summaries(findings: DataFrame, reports: DataFrame, k: int = 5) -> DataFrame:
    """One JSON text per project with its counters and most severe findings (at most ``k``)."""
    top = (
        listings.top_findings_by_source(findings, k)
        .groupBy("source")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "position",
                        F.struct(
                            "rule_id", "file", "line", "algorithm", "severity", "quantum_threat", "message"
                        ).alias("finding"),
                    )
                )
            ).alias("ranked")
        )
        .select("source", F.transform("ranked", lambda r: r["finding"]).alias("top_findings"))
    )
    risk = F.struct(
        "critical", "high", "medium", "low", "info", "safe", "total", "exempted", "by_quantum_threat", "by_primitive"
    )
    body = F.to_json(
        F.struct(
            "source",
            iso_utc(F.col("scanned_at")).alias("scanned_at"),
            "files_scanned",
            "rules_applied",
            "duration_ms",
            risk.alias("risk_summary"),
            F.struct("nist_fips_203", "nist_fips_204", "nis2", "dora").alias("compliance"),
            F.coalesce("top_findings", F.from_json(F.lit("[]"), top.schema["top_findings"].dataType)).alias(
                "top_findings"
            ),
            "top_algorithm",
        )
    )
    return (
        listings.top_algorithm(findings, reports)
        .join(top, "source", "left")
        .select("source", text.slug(F.col("source")).alias("slug"), body.alias("json"))
    )


def combined_document(
    findings: DataFrame, reports: DataFrame, scan_date: str, tool: str = "shorewatch", k: int = 10
) -> DataFrame:
    """Ordered fragments ``(part, slug, source, text)`` of the combined JSON.

    The global section is a few rows; projects stay one row each.
    """
    totals = portfolio.global_totals(reports)
    threat_map = portfolio.merged_counts(reports, "by_quantum_threat", "threat").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("threat", "findings")))).alias("by_quantum_threat")
    )
    algorithms_list = listings.top_algorithms(findings, k).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), "algorithm", "count"))),
            lambda a: F.struct(a["algorithm"].alias("algorithm"), a["count"].alias("count")),
        ).alias("top_algorithms")
    )
    verdicts = portfolio.compliance_counts(reports)
    pivoted = verdicts.agg(
        *[
            F.coalesce(F.max(F.when(F.col("framework") == f.upper(), F.col(n))), F.lit(0)).alias(f"{n}_{f}")
            for f in ("nis2", "dora")
            for n in ("non_compliant", "at_risk", "compliant")
        ]
    )
    # Four single-row tables, put side by side on a constant key.
    single = totals.withColumn("one", F.lit(1))
    for other in (threat_map, algorithms_list, pivoted):
        single = single.join(other.withColumn("one", F.lit(1)), "one")
    head = F.struct(
        F.struct(F.lit(scan_date).alias("scan_date"), F.lit(tool).alias("tool"), "projects_count").alias("meta"),
        F.struct(
            "files_scanned",
            "total_findings",
            "critical",
            "high",
            "medium",
            "low",
            "by_quantum_threat",
            "top_algorithms",
            F.struct(*pivoted.columns).alias("compliance_summary"),
        ).alias("global"),
    )
    json = F.to_json(head)
    empty = F.lit("")
    opening = single.select(
        F.lit(0).alias("part"),
        empty.alias("slug"),
        empty.alias("source"),
        F.concat(F.substring(json, F.lit(1), F.length(json) - 1), F.lit(',"projects":[')).alias("text"),
    )
    summaries = project_summaries(findings, reports)
    first = summaries.agg(F.min(F.struct("slug", "source")).alias("first")).withColumn("part", F.lit(1))
    items = (
        summaries.withColumn("part", F.lit(1))
        .join(F.broadcast(first), "part", "left")
        .select(
            "part",
            "slug",
            "source",
            F.concat(
                F.when(F.struct("slug", "source") == F.col("first"), "").otherwise(","), F.col("json")
            ).alias("text"),
        )
    )
    closing = findings.sparkSession.range(1).select(
        F.lit(2).alias("part"), empty.alias("slug"), empty.alias("source"), F.lit("]}").alias("text")
    )
    return opening.unionByName(items).unionByName(closing)
