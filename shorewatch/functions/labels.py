"""Display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shorewatch import values as V
from shorewatch.functions.severity import choose


def threat_label(threat: Column) -> Column:
    return choose(threat, V.THREAT_LABELS, threat)


def severity_class(severity: Column) -> Column:
    return choose(severity, V.SEVERITY_CLASSES, F.lit("sev-info"))


def verdict_class(verdict: Column) -> Column:
    return choose(verdict, V.VERDICT_CLASSES, F.lit("badge-unknown"))


def source_label(source: Column) -> Column:
    return F.coalesce(F.nullif(source, F.lit("")), F.lit(V.LOCAL_SOURCE_LABEL))
