"""Registration of queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contract import planted as P
from shorewatch.operators.rollup import report_rows
from shorewatch.plans.jobs import ScanResult, findings_to_table, scan_to_table, shared_directory
from shorewatch.operators.scan import match_rules, raw_findings, scan, select_files
from shorewatch.sources.rules import RulePack, _clean, bundled_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Context:
    """Lazily built inputs of one query run."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.as_of = F.lit(f"{P.AS_OF}+00:00").cast("timestamp")

    def table(self, name: str) -> DataFrame:
        return P.read(self.spark, self.sf_dir, name)

    @cached_property
    def pack(self) -> RulePack:
        return RulePack.layered(
            bundled_rules(), [_clean(r) for r in P.HOUSE_RULES], [_clean(r) for r in P.TEAM_RULES]
        )

    @cached_property
    def corpus(self) -> DataFrame:
        return P.corpus(self.spark, self.sf_dir)

    @cached_property
    def selected(self) -> DataFrame:
        return select_files(self.corpus, self.pack)

    @cached_property
    def matches(self) -> DataFrame:
        return match_rules(self.selected, self.pack)

    @cached_property
    def exemptions(self) -> DataFrame:
        return P.exemption_table(self.spark, self.sf_dir)

    @cached_property
    def inline(self) -> DataFrame:
        return raw_findings(self.corpus, self.pack, self.as_of)

    @cached_property
    def findings(self) -> DataFrame:
        return scan(self.corpus, self.pack, self.as_of, self.exemptions)

    @cached_property
    def reports(self) -> DataFrame:
        return report_rows(
            self.corpus, self.findings, self.pack, scanned_at=self.as_of, report_id=F.col("source"), ref="main"
        )

    @cached_property
    def stored_findings(self) -> DataFrame:
        """Findings written once, for queries that read nothing else, but more than once."""
        directory = shared_directory(self.spark, f"findings-{uuid4().hex}")
        return findings_to_table(self.corpus, self.pack, directory, self.exemptions, self.as_of)

    def stored_columns(self, *columns: str) -> DataFrame:
        """Those columns of the findings written once."""
        directory = shared_directory(self.spark, f"findings-{uuid4().hex}")
        return findings_to_table(self.corpus, self.pack, directory, self.exemptions, self.as_of, columns=columns)

    @cached_property
    def stored(self) -> ScanResult:
        """Findings and reports written once, for queries that read them more than once."""
        return self._stored()

    def stored_with(self, *columns: str) -> ScanResult:
        """Reports, and those columns of the findings beside the ones that reports are counted from, written once."""
        return self._stored(columns=columns)

    def _stored(self, **options) -> ScanResult:
        directory = shared_directory(self.spark, f"findings-{uuid4().hex}")
        return scan_to_table(
            self.corpus,
            self.pack,
            directory,
            self.exemptions,
            self.as_of,
            report_id=F.col("source"),
            ref="main",
            **options,
        )

    @cached_property
    def targets(self) -> DataFrame:
        return P.target_table(self.spark, self.sf_dir)


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Context], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Context(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def flat(findings: DataFrame) -> DataFrame:
    """Findings with the exemption as plain columns."""
    return findings.select(
        *[c for c in findings.columns if c != "exemption"],
        F.col("exemption.reason").alias("ex_reason"),
        F.col("exemption.owner").alias("ex_owner"),
        F.col("exemption.until").alias("ex_until"),
        F.col("exemption.source").alias("ex_source"),
    )


__all__ = ["Context", "ORACLES", "QUERIES", "flat", "query"]
