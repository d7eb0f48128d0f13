"""Severity, verdict and gate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shorewatch import values as V


def choose(key: Column, table: dict, default: Column) -> Column:
    """CASE over a small fixed table."""
    out = F
    for value, result in table.items():
        out = out.when(key == value, result)
    return out.otherwise(default)


def derive(threat: Column, primitive: Column) -> Column:
    """Default severity of a rule that does not pin one."""
    harvestable = (threat == "shor-broken") & primitive.isin(V.HARVESTABLE_PRIMITIVES)
    return F.when(harvestable, F.lit("CRITICAL")).otherwise(
        choose(threat, V.THREAT_SEVERITY, F.lit("MEDIUM"))
    )


def effective(severity: Column, threat: Column, primitive: Column) -> Column:
    return F.coalesce(F.nullif(severity, F.lit("")), derive(threat, primitive))


def rank(severity: Column) -> Column:
    """Higher is worse."""
    return choose(severity, V.SEVERITY_RANK, F.lit(0))


def listing_rank(severity: Column) -> Column:
    """Lower is worse; the order of top-k listings."""
    return choose(severity, V.LISTING_RANK, F.lit(4))


def sarif_level(severity: Column) -> Column:
    return choose(severity, V.SARIF_LEVEL, F.lit("note"))


def ci_level(severity: Column) -> Column:
    return choose(severity, V.CI_LEVEL, F.lit("notice"))


def verdict(critical: Column, high: Column) -> Column:
    fail, warn, ok = V.VERDICTS
    return F.when(critical > 0, fail).when(high > 0, warn).otherwise(ok)


def gate_failed(fail_on: Column, critical: Column, high: Column, total: Column) -> Column:
    """Does the build fail?  ``any`` looks at all findings, exempted ones included."""
    return (
        F.when(fail_on == "critical", critical > 0)
        .when(fail_on == "high", critical + high > 0)
        .when(fail_on == "any", total > 0)
        .otherwise(F.lit(False))
    )


def bar_percent(count: Column, largest: Column) -> Column:
    return F.call_function("div", count * 100, F.greatest(largest, F.lit(1))).cast("bigint")
