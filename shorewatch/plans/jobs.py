"""Whole jobs: corpus in, report tables out."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame

from shorewatch.operators.rollup import COUNTED_COLUMNS, report_rows
from shorewatch.operators.scan import scan
from shorewatch.operators.tables import shared_directory
from shorewatch.sources.rules import MAX_BROADCAST_BYTES, RulePack


class ScanResult(NamedTuple):
    findings: DataFrame
    reports: DataFrame


def scan_corpus(
    files: DataFrame,
    pack: RulePack,
    exemptions: DataFrame | None = None,
    as_of: Column | None = None,
    collect_bytes: int = MAX_BROADCAST_BYTES,
    **report_options,
) -> ScanResult:
    """Findings and one report row per source, both lazy."""
    findings = scan(files, pack, as_of, exemptions, collect_bytes)
    return ScanResult(findings, report_rows(files, findings, pack, scanned_at=as_of, **report_options))


def findings_to_table(
    files: DataFrame,
    pack: RulePack,
    directory: str,
    exemptions: DataFrame | None = None,
    as_of: Column | None = None,
    collect_bytes: int = MAX_BROADCAST_BYTES,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Scan once, write the findings below a shared directory, and continue from the written table.

    ``columns`` are those that later steps read, all unless given; the others are neither made nor written.
    """
    findings = scan(files, pack, as_of, exemptions, collect_bytes)
    return _written(findings if columns is None else findings.select(*columns), f"{directory}/findings")


def scan_to_table(
    files: DataFrame,
    pack: RulePack,
    directory: str,
    exemptions: DataFrame | None = None,
    as_of: Column | None = None,
    collect_bytes: int = MAX_BROADCAST_BYTES,
    columns: Sequence[str] | None = None,
    **report_options,
) -> ScanResult:
    """Findings and report rows as written tables; ``columns`` of findings as in :func:`findings_to_table`, and those of the reports.

    Documents and portfolio tables start from both several times.  Reading them back keeps the
    corpus from being scanned once per use, and lost executors from causing a rescan.
    """
    if columns is not None:
        columns = list(dict.fromkeys([*columns, *COUNTED_COLUMNS]))
    findings = findings_to_table(files, pack, directory, exemptions, as_of, collect_bytes, columns)
    reports = report_rows(files, findings, pack, scanned_at=as_of, **report_options)
    return ScanResult(findings, _written(reports, f"{directory}/reports"))


def _written(frame: DataFrame, path: str) -> DataFrame:
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


__all__ = ["ScanResult", "findings_to_table", "scan_corpus", "scan_to_table", "shared_directory"]
