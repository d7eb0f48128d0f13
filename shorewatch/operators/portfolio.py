"""Many reports together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shorewatch import values as V
from shorewatch.functions import text


def global_totals(reports: DataFrame) -> DataFrame:
    names = ["files_scanned", "total", "critical", "high", "medium", "low"]
    return reports.agg(
        F.count("*").alias("projects_count"),
        *[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("total_findings" if n == "total" else n) for n in names],
    )


def merged_counts(reports: DataFrame, column: str, name: str) -> DataFrame:
    """Key-wise sum of a count map over all reports."""
    return (
        reports.select(F.explode(column).alias(name, "n")).groupBy(name).agg(F.sum("n").cast("bigint").alias("findings"))
    )


def compliance_counts(reports: DataFrame) -> DataFrame:
    """Reports per framework and verdict, one row per framework."""
    frameworks = reports.select(
        F.stack(F.lit(2), F.lit("NIS2"), F.col("nis2"), F.lit("DORA"), F.col("dora")).alias("framework", "verdict")
    )
    names = ["non_compliant", "at_risk", "compliant"]
    return frameworks.groupBy("framework").agg(
        *[F.count_if(F.col("verdict") == v).alias(n) for v, n in zip(V.VERDICTS, names, strict=True)]
    )


def with_targets(reports: DataFrame, targets: DataFrame) -> DataFrame:
    """Name and category of the target each report belongs to."""
    return reports.join(
        targets.select(F.col("repo").alias("source"), "name", "category"), "source", "left"
    )


def category_totals(reports: DataFrame, targets: DataFrame) -> DataFrame:
    return (
        with_targets(reports, targets)
        .groupBy("category")
        .agg(
            F.count("*").alias("projects"),
            F.sum("total").cast("bigint").alias("total_findings"),
            F.sum("critical").cast("bigint").alias("critical"),
        )
    )


def select_targets(targets: DataFrame, only: list[str]) -> DataFrame:
    """Targets whose slug is listed; an empty list selects all."""
    return targets.where(text.slug(F.col("repo")).isin(only)) if only else targets


def join_selected(targets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Same with the wanted slugs in a table."""
    return targets.withColumn("slug", text.slug(F.col("repo"))).join(wanted.select("slug"), "slug", "left_semi")


def run_counters(runs: DataFrame) -> DataFrame:
    """Counters of a bulk run over ``runs(status)`` with scanned, skipped or failed."""
    status = F.col("status")
    return runs.agg(
        F.count_if(status == "scanned").alias("scanned"),
        F.count_if(status.isin("scanned", "failed")).alias("total"),
        F.count_if(status == "skipped").alias("skipped"),
        F.count_if(status == "failed").alias("failed"),
    )


def explode_reports(reports: DataFrame) -> DataFrame:
    """Findings of nested report rows, keeping their source and order."""
    return reports.select("source", F.posexplode("findings").alias("seq", "finding")).select(
        "source", "seq", "finding.*"
    )
