"""Risk summaries, compliance and report rows.

All of these are group-bys with partial aggregation, so a dominant repository is
reduced to a few counters per task before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorewatch import values as V
from shorewatch.functions import severity as sev
from shorewatch.functions import text
from shorewatch.sources.rules import RulePack


def counted(status: Column) -> Column:
    """Exempted findings stay in the report but out of the risk counts."""
    return status != V.EXEMPTED


def severity_counts(names: list[str], keep: Column) -> list[Column]:
    return [F.count_if((F.col("severity") == n.upper()) & keep).alias(n) for n in names]


#: Columns of findings that reports are counted from.
COUNTED_COLUMNS = ["source", "severity", "quantum_threat", "primitive", "status"]


def risk_summary(findings: DataFrame) -> DataFrame:
    """One row per source: severity counts, totals and both taxonomy maps in one pass.

    The taxonomy values are a fixed set, so they are plain counters until the end.
    """
    keep = counted(F.col("status"))
    threats = [F.count_if((F.col("quantum_threat") == t) & keep).alias(f"t{i}") for i, t in enumerate(V.THREATS)]
    primitives = [F.count_if((F.col("primitive") == p) & keep).alias(f"p{i}") for i, p in enumerate(V.PRIMITIVES)]
    rows = findings.groupBy("source").agg(
        *severity_counts(["critical", "high", "medium", "low", "info", "safe"], keep),
        F.count("*").alias("total"),
        F.count_if(F.col("status") == V.EXEMPTED).alias("exempted"),
        F.count_if(F.col("status") == V.ACTIVE).alias("active"),
        *threats,
        *primitives,
    )

    def positive(prefix: str, names: list[str]) -> Column:
        pairs = [part for i, n in enumerate(names) for part in (F.lit(n), F.col(f"{prefix}{i}"))]
        return F.map_filter(F.create_map(*pairs), lambda _, count: count > 0)

    return rows.select(
        "source",
        "critical",
        "high",
        "medium",
        "low",
        "info",
        "safe",
        "total",
        "exempted",
        "active",
        positive("t", V.THREATS).alias("by_quantum_threat"),
        positive("p", V.PRIMITIVES).alias("by_primitive"),
    )


def axis_counts(findings: DataFrame, axis: str) -> DataFrame:
    """Counted findings per source and non-empty value of one column."""
    value = F.col(axis)
    return (
        findings.where(counted(F.col("status")) & (F.coalesce(value, F.lit("")) != ""))
        .groupBy("source", axis)
        .agg(F.count("*").alias("findings"))
    )


def risk_axes(findings: DataFrame) -> DataFrame:
    """Severity, threat and primitive counts per source as one grouping-sets query."""
    sets = [
        [F.col("source"), F.col("severity")],
        [F.col("source"), F.col("quantum_threat")],
        [F.col("source"), F.col("primitive")],
    ]
    axis = F.when(F.grouping("severity") == 0, "severity").when(
        F.grouping("quantum_threat") == 0, "quantum_threat"
    ).otherwise("primitive")
    return (
        findings.where(counted(F.col("status")))
        .groupingSets(sets, "source", "severity", "quantum_threat", "primitive")
        .agg(F.count("*").alias("findings"), axis.alias("axis"))
        .select("source", "axis", F.coalesce("severity", "quantum_threat", "primitive").alias("value"), "findings")
        .where(F.col("value") != "")
    )


def files_scanned(files: DataFrame, pack: RulePack) -> DataFrame:
    """Scannable files per source, counted from paths alone; sources without any count zero."""
    known = text.extension(F.col("file")).isin(sorted(pack.extension_map))
    wanted = known & ~text.in_skipped_directory(F.col("file"))
    return files.groupBy("source").agg(F.count_if(wanted).alias("files_scanned"))


def with_compliance(risk: DataFrame) -> DataFrame:
    verdict = sev.verdict(F.col("critical"), F.col("high"))
    return risk.withColumns({name: verdict for name in ("nist_fips_203", "nist_fips_204", "nis2", "dora")})


COUNTERS = ["critical", "high", "medium", "low", "info", "safe", "total", "exempted", "active"]


def report_rows(
    files: DataFrame,
    findings: DataFrame,
    pack: RulePack,
    scanned_at: Column | None = None,
    report_id: Column | None = None,
    ref: str = "",
    sha: str = "",
    duration_ms: int = 0,
) -> DataFrame:
    """One flat report row per source; sources without findings are compliant zeros."""
    joined = files_scanned(files, pack).join(risk_summary(findings), "source", "left")
    zeros = {name: F.coalesce(F.col(name), F.lit(0).cast("bigint")) for name in COUNTERS}
    return with_compliance(joined.withColumns(zeros)).withColumns(
        {
            "id": F.uuid() if report_id is None else report_id,
            "scanned_at": F.current_timestamp() if scanned_at is None else scanned_at,
            "ref": F.lit(ref),
            "sha": F.lit(sha),
            "duration_ms": F.lit(duration_ms).cast("bigint"),
            "rules_applied": F.lit(len(pack)).cast("bigint"),
        }
    )


def gate(reports: DataFrame, fail_on: str = "critical") -> DataFrame:
    failed = sev.gate_failed(F.lit(fail_on), F.col("critical"), F.col("high"), F.col("total"))
    return reports.withColumn("failed", failed)
