"""Roll-ups, listings, portfolio and report shapes."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from contract import oracle_base as O
from contract.oracle_base import case
from contract.registry import Context, query
from shorewatch import model
from shorewatch import values as V
from shorewatch.functions import labels
from shorewatch.functions import severity as sev
from shorewatch.functions import text
from shorewatch.operators import diff, listings, portfolio, rollup
from shorewatch.operators.positions import numbered
from shorewatch.operators.scan import scan
from shorewatch.plans.jobs import shared_directory
from shorewatch.sinks import digest, documents
from shorewatch.sources.reports import read_report_documents

_RANK = case("severity", V.LISTING_RANK, "4")
_SEQ = "string_split(file, '/'), rule_ord, line"


def _big(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({n: F.col(n).cast("bigint") for n in names})


# -- roll-ups ----------------------------------------------------------------


@query(
    "a1_severity_counts",
    O.from_reports("SELECT source, critical, high, medium, low, info, safe FROM risk"),
)
def a1_severity_counts(c: Context) -> DataFrame:
    return rollup.risk_summary(c.findings).select("source", "critical", "high", "medium", "low", "info", "safe")


def _axis_sql(axis: str) -> str:
    return O.from_findings(
        f"""SELECT source, {axis}, count(*) AS findings FROM findings
            WHERE status <> 'exempted' AND {axis} <> '' GROUP BY ALL"""
    )


@query("a2_threat_counts", _axis_sql("quantum_threat"))
def a2_threat_counts(c: Context) -> DataFrame:
    return rollup.axis_counts(c.findings, "quantum_threat")


@query("a3_primitive_counts", _axis_sql("primitive"))
def a3_primitive_counts(c: Context) -> DataFrame:
    return rollup.axis_counts(c.findings, "primitive")


@query(
    "a2_risk_axes",
    O.from_findings(
        " UNION ALL ".join(
            f"""SELECT source, '{axis}' AS axis, {axis} AS value, count(*) AS findings FROM findings
                WHERE status <> 'exempted' GROUP BY ALL"""
            for axis in ("severity", "quantum_threat", "primitive")
        )
    ),
)
def a2_risk_axes(c: Context) -> DataFrame:
    return rollup.risk_axes(c.findings)


@query("a2_risk_summary_maps", O.from_findings(
    " UNION ALL ".join(
        f"""SELECT source, '{axis}' AS axis, {axis} AS value, count(*) AS findings FROM findings
            WHERE status <> 'exempted' GROUP BY ALL"""
        for axis in ("quantum_threat", "primitive")
    )
))
def a2_risk_summary_maps(c: Context) -> DataFrame:
    """The maps of the one-pass summary, exploded."""
    risk = rollup.risk_summary(c.findings)
    # Both maps of a row are exploded together, so that the corpus is scanned once.
    maps = F.create_map(F.lit("quantum_threat"), F.col("by_quantum_threat"), F.lit("primitive"), F.col("by_primitive"))
    return risk.select("source", F.explode(maps).alias("axis", "counts")).select("source", "axis", F.explode("counts").alias("value", "findings"))


@query("a4_totals", O.from_reports("SELECT source, total, exempted FROM risk"))
def a4_totals(c: Context) -> DataFrame:
    return rollup.risk_summary(c.findings).select("source", "total", "exempted")


@query(
    "a5_files_scanned",
    O.with_steps(
        """SELECT c.source, count(s.file) AS files_scanned, (SELECT count(*) FROM rules) AS rules_applied
            FROM corpus c LEFT JOIN selected s ON c.source = s.source AND c.file = s.file GROUP BY 1""",
        O.CORPUS,
        O.SELECTED,
        O.RULES,
    ),
)
def a5_files_scanned(c: Context) -> DataFrame:
    return rollup.files_scanned(c.corpus, c.pack).withColumn("rules_applied", F.lit(len(c.pack)).cast("bigint"))


@query("a12_active_findings", O.from_reports("SELECT source, active FROM reports"))
def a12_active_findings(c: Context) -> DataFrame:
    return c.reports.select("source", "active")


@query(
    "p18_compliance",
    O.from_reports(
        """SELECT source, verdict AS nist_fips_203, verdict AS nist_fips_204, verdict AS nis2, verdict AS dora,
              CASE verdict WHEN 'NON-COMPLIANT' THEN 'badge-fail' WHEN 'AT RISK' THEN 'badge-warn'
                   WHEN 'COMPLIANT' THEN 'badge-pass' ELSE 'badge-unknown' END AS badge FROM reports"""
    ),
)
def p18_compliance(c: Context) -> DataFrame:
    return c.reports.select(
        "source", "nist_fips_203", "nist_fips_204", "nis2", "dora", labels.verdict_class(F.col("nis2")).alias("badge")
    )


@query(
    "p20_fail_gate",
    O.from_reports(
        """SELECT source, mode AS fail_on, CASE mode WHEN 'critical' THEN critical > 0 WHEN 'high' THEN critical + high > 0
                WHEN 'any' THEN total > 0 ELSE false END AS failed
           FROM reports, (SELECT unnest(['critical', 'high', 'any', 'never']) AS mode)"""
    ),
)
def p20_fail_gate(c: Context) -> DataFrame:
    modes = c.reports.withColumn("fail_on", F.explode(F.array(*[F.lit(m) for m in V.FAIL_MODES])))
    failed = sev.gate_failed(F.col("fail_on"), F.col("critical"), F.col("high"), F.col("total"))
    return modes.select("source", "fail_on", failed.alias("failed"))


@query(
    "p21_report_rows",
    O.from_reports(
        """SELECT source, 'main' AS ref, '' AS sha, CAST(0 AS BIGINT) AS duration_ms, files_scanned, rules_applied,
              critical, high, medium, low, info, safe, total, exempted, verdict AS nis2 FROM reports"""
    ),
)
def p21_report_rows(c: Context) -> DataFrame:
    return c.reports.select(
        "source", "ref", "sha", "duration_ms", "files_scanned", "rules_applied", "critical", "high", "medium", "low",
        "info", "safe", "total", "exempted", "nis2",
    )


# -- listings ----------------------------------------------------------------


_ALG = """alg AS (SELECT source, algorithm, count(*) AS "count" FROM findings
                  WHERE status = 'active' AND algorithm <> '' GROUP BY ALL)"""


@query(
    "a6_top_algorithms",
    O.from_reports(
        """SELECT algorithm, CAST(sum("count") AS BIGINT) AS "count" FROM alg GROUP BY 1
           ORDER BY 2 DESC, 1 LIMIT 10""",
        _ALG,
    ),
)
def a6_top_algorithms(c: Context) -> DataFrame:
    return listings.top_algorithms(c.findings)


_TOP_ALG = """SELECT source, position, algorithm, "count", CAST("count" * 100 // greatest(largest, 1) AS BIGINT) AS bar_pct
    FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY "count" DESC, algorithm) AS position,
                 max("count") OVER (PARTITION BY source) AS largest FROM alg) WHERE position <= 10"""


@query("o2_top_algorithms_by_source", O.from_reports(_TOP_ALG, _ALG))
def o2_top_algorithms_by_source(c: Context) -> DataFrame:
    return _big(listings.top_algorithms_by_source(c.findings), "position")


@query(
    "p19_bar_percent",
    O.from_reports(f"SELECT source, algorithm, bar_pct FROM ({_TOP_ALG})", _ALG),
)
def p19_bar_percent(c: Context) -> DataFrame:
    return listings.top_algorithms_by_source(c.findings).select("source", "algorithm", "bar_pct")


@query(
    "a14_max_algorithm_count",
    O.from_reports(
        """SELECT r.source, CAST(greatest(coalesce(max(a."count"), 1), 1) AS BIGINT) AS max_count
           FROM reports r LEFT JOIN alg a ON r.source = a.source GROUP BY 1""",
        _ALG,
    ),
)
def a14_max_algorithm_count(c: Context) -> DataFrame:
    largest = listings.algorithm_counts(c.findings, "source").groupBy("source").agg(F.max("count").alias("largest"))
    return c.corpus.select("source").distinct().join(largest, "source", "left").select(
        "source", F.greatest(F.coalesce("largest", F.lit(1)), F.lit(1)).cast("bigint").alias("max_count")
    )


_FILE_GROUPS = """SELECT source, file, count(*) FILTER (severity = 'CRITICAL') AS critical,
        count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
        count(*) FILTER (severity = 'LOW') AS low, count(*) AS findings,
        CASE WHEN len(string_split(file, '/')) > 3 THEN array_to_string(string_split(file, '/')[-3:], '/')
             ELSE file END AS short
    FROM findings WHERE status = 'active' GROUP BY source, file"""


@query("a7_file_groups", O.from_findings(_FILE_GROUPS))
def a7_file_groups(c: Context) -> DataFrame:
    return listings.file_groups(c.findings)


@query(
    "o1_worst_files",
    O.from_findings(f"SELECT * FROM ({_FILE_GROUPS}) ORDER BY critical DESC, high DESC, file, source"),
)
def o1_worst_files(c: Context) -> DataFrame:
    return listings.file_groups(c.findings).orderBy(*listings.file_group_order(), "source")


_TOP_COLUMNS = "source, file, rule_id, CAST(line AS BIGINT) AS line, algorithm, severity, quantum_threat"


def _top_columns(frame: DataFrame, *more: str) -> DataFrame:
    return _big(frame, "line").select(
        *more, "source", "file", "rule_id", "line", "algorithm", "severity", "quantum_threat"
    )


@query(
    "o3_top_findings",
    O.from_findings(
        f"""SELECT {_TOP_COLUMNS} FROM findings WHERE status = 'active'
            ORDER BY {_RANK}, replace(source, '/', '-'), source, {_SEQ} LIMIT 10"""
    ),
)
def o3_top_findings(c: Context) -> DataFrame:
    return _top_columns(listings.top_findings(c.findings, 10))


@query(
    "w5_top_findings_by_source",
    O.from_findings(
        f"""SELECT position, {_TOP_COLUMNS} FROM (
              SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_RANK}, {_SEQ}) AS position
              FROM findings WHERE status = 'active') WHERE position <= 5"""
    ),
)
def w5_top_findings_by_source(c: Context) -> DataFrame:
    return _top_columns(_big(listings.top_findings_by_source(c.findings, 5), "position"), "position")


@query(
    "o4_walk_order",
    O.from_selected(
        """SELECT source, file, row_number() OVER (PARTITION BY source ORDER BY string_split(file, '/')) AS position
           FROM selected"""
    ),
)
def o4_walk_order(c: Context) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy(text.segments(F.col("file")))
    ranked = c.selected.select("source", "file").withColumn("position", F.row_number().over(order))
    return _big(ranked, "position")


@query(
    "o5_threat_order",
    O.from_findings(
        """SELECT row_number() OVER (ORDER BY findings DESC, threat) AS position, threat, findings FROM (
             SELECT quantum_threat AS threat, count(*) AS findings FROM findings WHERE status <> 'exempted' GROUP BY 1)"""
    ),
)
def o5_threat_order(c: Context) -> DataFrame:
    """Eight threat values at most reach the numbering."""
    from pyspark.sql import Window

    merged = portfolio.merged_counts(c.reports, "by_quantum_threat", "threat")
    order = Window.orderBy(F.desc("findings"), "threat")
    return _big(merged.withColumn("position", F.row_number().over(order)), "position")


@query(
    "s15_project_page",
    O.from_findings(
        f"""SELECT source, lower(severity) AS severity_class, severity, algorithm,
              CASE WHEN len(string_split(file, '/')) > 3 THEN array_to_string(string_split(file, '/')[-3:], '/')
                   ELSE file END AS short_file, file, CAST(line AS BIGINT) AS line, quantum_threat,
              {case("quantum_threat", V.THREAT_LABELS, "quantum_threat")} AS threat_label, message
            FROM findings WHERE status = 'active'"""
    ),
)
def s15_project_page(c: Context) -> DataFrame:
    return _big(listings.project_page(c.findings), "line")


_GROUPS = """grouped AS (
  SELECT source, file, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
         count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) AS n,
         CASE WHEN len(string_split(file, '/')) > 3 THEN array_to_string(string_split(file, '/')[-3:], '/') ELSE file END AS short
  FROM findings WHERE status = 'active' GROUP BY source, file),
groups AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY critical DESC, high DESC, file) AS position FROM grouped),
listed AS (
  SELECT f.*, g.position, g.short, row_number() OVER (PARTITION BY f.source, f.file ORDER BY f.rule_ord, f.line) AS nth
  FROM findings f JOIN groups g ON f.source = g.source AND f.file = g.file WHERE f.status = 'active')"""


@query(
    "a7_file_listing",
    O.from_reports(
        """SELECT source, file, short, CAST(position AS BIGINT) AS position, CAST(nth AS BIGINT) AS nth, rule_id,
             CAST(line AS BIGINT) AS line, severity, algorithm FROM listed""",
        _GROUPS,
    ),
)
def a7_file_listing(c: Context) -> DataFrame:
    """The findings of every file group, each with its place."""
    found = c.stored_columns(*listings.LISTED_COLUMNS)
    return _big(listings.file_listing(found), "position", "nth", "line").select(
        "source", "file", "short", "position", "nth", "rule_id", "line", "severity", "algorithm"
    )


@query(
    "s14_view_model",
    O.from_reports(
        """SELECT r.source, 'total' AS section, CAST(0 AS BIGINT) AS position, CAST(0 AS BIGINT) AS nth, 'active' AS name, '' AS detail,
              r.active AS "count", coalesce(max(a."count"), 1) AS bar
            FROM reports r LEFT JOIN alg a ON r.source = a.source GROUP BY r.source, r.active
            UNION ALL SELECT source, 'algorithm', position, 0, algorithm, '', "count", "count" * 100 // largest FROM (
              SELECT *, row_number() OVER (PARTITION BY source ORDER BY "count" DESC, algorithm) AS position,
                max("count") OVER (PARTITION BY source) AS largest FROM alg) WHERE position <= 10
            UNION ALL SELECT source, 'file', position, 0, short, concat_ws('/', critical, high, medium, low), n, 0 FROM groups
            UNION ALL SELECT source, 'finding', position, nth, rule_id, concat_ws(':', severity, algorithm, line), 1, 0 FROM listed""",
        _ALG,
        _GROUPS,
    ),
)
def s14_view_model(c: Context) -> DataFrame:
    stored = c.stored_with(*listings.LISTED_COLUMNS)
    return listings.view_model(stored.findings, stored.reports)


@query(
    "s12_ci_lines",
    O.from_findings(
        f"""SELECT source, file, CAST(line AS BIGINT) AS line, rule_id, level,
              '::' || level || ' file=' || file || ',line=' || CAST(line AS VARCHAR) || '::[' || algorithm || '] '
                || message AS "text"
            FROM (SELECT *, {case("severity", V.CI_LEVEL, "'notice'")} AS level FROM findings)"""
    ),
)
def s12_ci_lines(c: Context) -> DataFrame:
    return _big(listings.ci_lines(c.findings), "line")


_METRICS = [
    ("Files scanned", "files_scanned"),
    ("Total findings", "total"),
    ("Critical", "critical"),
    ("High", "high"),
    ("NIS2", "verdict"),
    ("DORA", "verdict"),
    ("NIST FIPS 203", "verdict"),
    ("NIST FIPS 204", "verdict"),
]


@query(
    "s13_step_summary",
    O.from_reports(
        " UNION ALL ".join(
            f"SELECT source, CAST({i} AS BIGINT) AS ord, '{m}' AS metric, CAST({col} AS VARCHAR) AS value FROM reports"
            for i, (m, col) in enumerate(_METRICS)
        )
    ),
)
def s13_step_summary(c: Context) -> DataFrame:
    return _big(listings.step_summary(c.reports), "ord")


_FIRST = f"""first AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_SEQ}) - 1 AS rule_index FROM (
    SELECT *, row_number() OVER (PARTITION BY source, rule_id ORDER BY {_SEQ}) AS nth FROM findings) WHERE nth = 1)"""


@query(
    "a13_report_rules",
    O.from_reports(
        "SELECT source, rule_id, algorithm, severity, message, migration, quantum_threat, primitive, composition FROM first",
        _FIRST,
    ),
)
def a13_report_rules(c: Context) -> DataFrame:
    return listings.report_rules(c.findings).drop("rule_index")


@query(
    "w4_rule_index",
    O.from_reports("SELECT source, rule_id, CAST(rule_index AS BIGINT) AS rule_index FROM first", _FIRST),
)
def w4_rule_index(c: Context) -> DataFrame:
    return _big(listings.report_rules(c.findings).select("source", "rule_id", "rule_index"), "rule_index")


@query(
    "j6_result_rule_index",
    O.from_reports(
        """SELECT f.source, f.file, CAST(f.line AS BIGINT) AS line, f.rule_id, CAST(x.rule_index AS BIGINT) AS rule_index
           FROM findings f JOIN first x ON f.source = x.source AND f.rule_id = x.rule_id""",
        _FIRST,
    ),
)
def j6_result_rule_index(c: Context) -> DataFrame:
    indexed = documents.with_rule_index(c.stored_findings, listings.report_rules(c.stored_findings))
    return _big(indexed, "line", "rule_index").select("source", "file", "line", "rule_id", "rule_index")


@query(
    "p14_sarif_results",
    O.from_reports(
        f"""SELECT f.source, f.rule_id, CAST(x.rule_index AS BIGINT) AS rule_index,
              {case("f.severity", V.SARIF_LEVEL, "'note'")} AS level, f.file AS uri, CAST(f.line AS BIGINT) AS start_line,
              CASE WHEN f.ex_source = 'config' THEN 'external' WHEN f.ex_source IS NOT NULL THEN 'inSource' END AS kind,
              f.ex_reason AS justification
            FROM findings f JOIN first x ON f.source = x.source AND f.rule_id = x.rule_id""",
        _FIRST,
    ),
)
def p14_sarif_results(c: Context) -> DataFrame:
    """Fields read back from the nested result objects."""
    indexed = documents.with_rule_index(c.stored_findings, listings.report_rules(c.stored_findings))
    r = indexed.select("source", documents.sarif_result().alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    suppression = F.get(F.col("r.suppressions"), F.lit(0))
    return r.select(
        "source",
        F.col("r.ruleId").alias("rule_id"),
        F.col("r.ruleIndex").cast("bigint").alias("rule_index"),
        F.col("r.level").alias("level"),
        place["artifactLocation"]["uri"].alias("uri"),
        place["region"]["startLine"].cast("bigint").alias("start_line"),
        suppression["kind"].alias("kind"),
        suppression["justification"].alias("justification"),
    )


# -- portfolio ---------------------------------------------------------------


@query(
    "a8_global_totals",
    O.from_reports(
        """SELECT count(*) AS projects_count, CAST(sum(files_scanned) AS BIGINT) AS files_scanned,
              CAST(sum(total) AS BIGINT) AS total_findings, CAST(sum(critical) AS BIGINT) AS critical,
              CAST(sum(high) AS BIGINT) AS high, CAST(sum(medium) AS BIGINT) AS medium, CAST(sum(low) AS BIGINT) AS low
           FROM reports"""
    ),
)
def a8_global_totals(c: Context) -> DataFrame:
    return portfolio.global_totals(c.reports)


@query(
    "a9_merged_threats",
    O.from_findings(
        "SELECT quantum_threat AS threat, count(*) AS findings FROM findings WHERE status <> 'exempted' GROUP BY 1"
    ),
)
def a9_merged_threats(c: Context) -> DataFrame:
    return portfolio.merged_counts(c.reports, "by_quantum_threat", "threat")


@query(
    "a10_compliance_pivot",
    O.from_reports(
        """SELECT framework, count(*) FILTER (verdict = 'NON-COMPLIANT') AS non_compliant,
              count(*) FILTER (verdict = 'AT RISK') AS at_risk, count(*) FILTER (verdict = 'COMPLIANT') AS compliant
           FROM reports, (SELECT unnest(['NIS2', 'DORA']) AS framework) GROUP BY 1"""
    ),
)
def a10_compliance_pivot(c: Context) -> DataFrame:
    return portfolio.compliance_counts(c.reports)


_BEST = """best AS (SELECT source, algorithm FROM alg QUALIFY
    row_number() OVER (PARTITION BY source ORDER BY "count" DESC, algorithm) = 1)"""


@query(
    "a11_top_algorithm",
    O.from_reports(
        """SELECT r.source, coalesce(b.algorithm, 'n/a') AS top_algorithm
           FROM reports r LEFT JOIN best b ON r.source = b.source""",
        _ALG,
        _BEST,
    ),
)
def a11_top_algorithm(c: Context) -> DataFrame:
    return listings.top_algorithm(c.findings, c.corpus.select("source").distinct()).select("source", "top_algorithm")


_RUN = "CASE WHEN key % 7 = 2 THEN 'skipped' WHEN key % 11 = 3 THEN 'failed' ELSE 'scanned' END"


@query(
    "a15_run_counters",
    f"""WITH runs AS (SELECT {_RUN.replace("key", "s_suppkey")} AS status FROM supplier)
        SELECT count(*) FILTER (status = 'scanned') AS scanned, count(*) FILTER (status <> 'skipped') AS total,
               count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed FROM runs""",
)
def a15_run_counters(c: Context) -> DataFrame:
    key = F.col("s_suppkey")
    status = F.when(key % 7 == 2, "skipped").when(key % 11 == 3, "failed").otherwise("scanned")
    return portfolio.run_counters(c.table("supplier").select(status.alias("status")))


@query(
    "j9_target_metadata",
    O.from_reports(
        """SELECT t.category, count(*) AS projects, CAST(sum(r.total) AS BIGINT) AS total_findings,
              CAST(sum(r.critical) AS BIGINT) AS critical
           FROM reports r LEFT JOIN targets t ON r.source = t.repo GROUP BY 1""",
        O.TARGETS,
    ),
)
def j9_target_metadata(c: Context) -> DataFrame:
    return portfolio.category_totals(c.reports, c.targets)


@query(
    "a16_report_positions",
    O.from_findings(
        f"""SELECT source, file, rule_id, CAST(line AS BIGINT) AS line,
              CAST(row_number() OVER (PARTITION BY source ORDER BY {_SEQ}) AS BIGINT) AS seq FROM findings"""
    ),
)
def a16_report_positions(c: Context) -> DataFrame:
    """The place of every finding in its report."""
    # Only what is shown, and what orders it, is written, dealt out and written again.
    found = c.stored_columns("source", "file", "rule_ord", "rule_id", "line")
    placed = numbered(found, ["source"], listings.report_order())
    return _big(placed, "line").select("source", "file", "rule_id", "line", "seq")


@query(
    "j8_report_findings",
    O.from_findings(
        f"""SELECT source, file, CAST(row_number() OVER (PARTITION BY source ORDER BY {_SEQ}) - 1 AS BIGINT) AS seq, rule_id,
              CAST(line AS BIGINT) AS line, status, algorithm, severity, sha256(snippet) AS snippet, ex_reason FROM findings"""
    ),
)
def j8_report_findings(c: Context) -> DataFrame:
    """Findings of saved reports with their report's source and their place in it: documents are written and read back."""
    _, findings = _read_back(c)
    return _big(findings, "line").select(
        "source", "file", "seq", "rule_id", "line", "status", "algorithm", "severity",
        F.sha2("snippet", 256).alias("snippet"), F.col("exemption.reason").alias("ex_reason"),
    )


def _read_back(c: Context) -> tuple[DataFrame, DataFrame]:
    folder = shared_directory(c.spark, f"documents-{uuid4().hex}")
    documents.write_documents(documents.report_document(c.stored.reports, c.stored.findings), folder, "gzip")
    return read_report_documents(c.spark, folder)


@query(
    "s7_saved_reports",
    O.from_reports(
        """SELECT source, CAST(files_scanned AS BIGINT) AS files_scanned, rules_applied, critical, high, medium, low, info, safe,
              total, exempted, verdict AS nis2, verdict AS dora, CAST(NULL AS VARCHAR) AS problem FROM reports"""
    ),
)
def s7_saved_reports(c: Context) -> DataFrame:
    """Heads and tails of the saved reports, each put together from several part files."""
    reports, _ = _read_back(c)
    risk = ("critical", "high", "medium", "low", "info", "safe", "total", "exempted")
    return reports.select(
        "source", "files_scanned", "rules_applied", *[f"risk_summary.{n}" for n in risk], "compliance.nis2", "compliance.dora", "problem"
    )


# -- documents ---------------------------------------------------------------


@query(
    "s11_digest_overview",
    O.from_reports(
        """SELECT '| ' || metric || ' | ' || CAST(value AS VARCHAR) || ' |' AS "row" FROM (
             SELECT 'Projects scanned' AS metric, count(*) AS value FROM reports
             UNION ALL SELECT 'Total files scanned', CAST(sum(files_scanned) AS BIGINT) FROM reports
             UNION ALL SELECT 'Total findings', CAST(sum(total) AS BIGINT) FROM reports
             UNION ALL SELECT 'Critical', CAST(sum(critical) AS BIGINT) FROM reports
             UNION ALL SELECT 'High', CAST(sum(high) AS BIGINT) FROM reports
             UNION ALL SELECT 'Medium', CAST(sum(medium) AS BIGINT) FROM reports
             UNION ALL SELECT 'Low', CAST(sum(low) AS BIGINT) FROM reports)"""
    ),
)
def s11_digest_overview(c: Context) -> DataFrame:
    return digest.overview(c.reports).select("row")


@query(
    "s11_digest_compliance",
    O.from_reports(
        """SELECT '| ' || title || ' | ' || CAST(count(*) FILTER (verdict = 'NON-COMPLIANT') AS VARCHAR) || ' | '
              || CAST(count(*) FILTER (verdict = 'AT RISK') AS VARCHAR) || ' | '
              || CAST(count(*) FILTER (verdict = 'COMPLIANT') AS VARCHAR) || ' |' AS "row"
           FROM reports, (SELECT unnest(['NIS2 (Article 21)', 'DORA (Article 9)']) AS title) GROUP BY title"""
    ),
)
def s11_digest_compliance(c: Context) -> DataFrame:
    return digest.compliance(c.reports).select("row")


@query(
    "s11_digest_algorithms",
    O.from_reports(
        """SELECT '| ' || algorithm || ' | ' || CAST(n AS VARCHAR) || ' |' AS "row" FROM (
             SELECT algorithm, CAST(sum("count") AS BIGINT) AS n FROM alg GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)""",
        _ALG,
    ),
)
def s11_digest_algorithms(c: Context) -> DataFrame:
    return digest.algorithms(c.findings).select("row")


@query(
    "s11_digest_threats",
    O.from_findings(
        """SELECT '| ' || quantum_threat || ' | ' || CAST(count(*) AS VARCHAR) || ' |' AS "row"
           FROM findings WHERE status <> 'exempted' GROUP BY quantum_threat"""
    ),
)
def s11_digest_threats(c: Context) -> DataFrame:
    return digest.threats(c.reports).select("row")


@query(
    "s11_digest_projects",
    O.from_reports(
        """SELECT '| ' || concat_ws(' | ', r.source, files_scanned, critical, high, medium, low, total,
              coalesce(b.algorithm, 'n/a'), verdict, verdict) || ' |' AS "row"
           FROM reports r LEFT JOIN best b ON r.source = b.source""",
        _ALG,
        _BEST,
    ),
)
def s11_digest_projects(c: Context) -> DataFrame:
    return digest.projects(c.stored.findings, c.stored.reports).select("row")


@query(
    "s11_digest_findings",
    O.from_findings(
        f"""SELECT '| ' || concat_ws(' | ', source, '`' || string_split(file, '/')[-1] || '`', line, algorithm, severity,
              quantum_threat) || ' |' AS "row"
            FROM (SELECT * FROM findings WHERE status = 'active'
                  ORDER BY {_RANK}, replace(source, '/', '-'), source, {_SEQ} LIMIT 10)"""
    ),
)
def s11_digest_findings(c: Context) -> DataFrame:
    return digest.worst_findings(c.findings).select("row")


@query("s8_report_documents")
def s8_report_documents(c: Context) -> DataFrame:
    return documents.report_document(c.stored.reports, c.stored.findings).select("source", "part", "rule_ord", "line", "text")


_READ_BACK = """rule_id, file, CAST(line AS BIGINT) AS line, CAST("column" AS BIGINT) AS "column", algorithm, severity,
  CAST(confidence AS BIGINT) AS confidence, snippet, message, migration, nullif(quantum_threat, '') AS quantum_threat,
  nullif(primitive, '') AS primitive, status"""


def _written_items(c: Context, fragments: DataFrame, name: str, parsed: DataType | str) -> DataFrame:
    """Findings of documents, in their order, that are written and read again, a fragment at a time."""
    folder = shared_directory(c.spark, f"{name}-{uuid4().hex}")
    documents.write_documents(fragments, folder, "gzip", ordered=True)
    read = c.spark.read.schema("value string, source string").text(folder)
    comma = F.startswith("value", F.lit(","))
    body = F.when(comma, F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))
    return read.select("source", comma.alias("after_comma"), F.from_json(body, parsed).alias("r"))


@query(
    "s8_report_items",
    O.from_findings(
        f"""SELECT source, {_READ_BACK}, ex_reason, nullif(ex_owner, '') AS ex_owner, nullif(ex_until, '') AS ex_until, ex_source,
              row_number() OVER (PARTITION BY source ORDER BY string_split(file, '/'), rule_ord, line) > 1 AS after_comma
            FROM findings"""
    ),
)
def s8_report_items(c: Context) -> DataFrame:
    """All fields of the findings in the written JSON reports, and which of them a comma goes before."""
    items = _written_items(c, documents.report_items(c.stored.findings, ordered=True), "reports", model.REPORT_FINDING)
    plain = ["rule_id", "file", "algorithm", "severity", "snippet", "message", "migration", "quantum_threat", "primitive", "status"]
    return items.select(
        "source",
        "after_comma",
        *[F.col(f"r.{n}") for n in plain],
        *[F.col(f"r.{n}").cast("bigint").alias(n) for n in ("line", "column", "confidence")],
        *[F.col(f"r.exemption.{n}").alias(f"ex_{n}") for n in ("reason", "owner", "until", "source")],
    )


@query(
    "s9_sarif_items",
    O.from_reports(
        f"""SELECT f.source, f.rule_id, CAST(x.rule_index AS BIGINT) AS rule_index,
              {case("f.severity", V.SARIF_LEVEL, "'note'")} AS level, f.file AS uri, CAST(f.line AS BIGINT) AS start_line,
              sha256(f.rule_id || '|' || f.file || '|' || trim(regexp_replace(f.snippet, {O.lit("[" + V.SPACE_CLASS + "]+")}, ' ', 'g')))
                AS fingerprint,
              CASE WHEN f.ex_source = 'config' THEN 'external' WHEN f.ex_source IS NOT NULL THEN 'inSource' END AS kind,
              f.ex_reason AS justification,
              row_number() OVER (PARTITION BY f.source ORDER BY string_split(f.file, '/'), f.rule_ord, f.line) > 1 AS after_comma
            FROM findings f JOIN first x ON f.source = x.source AND f.rule_id = x.rule_id""",
        _FIRST,
    ),
)
def s9_sarif_items(c: Context) -> DataFrame:
    """Results of the written SARIF documents."""
    parsed = """ruleId string, ruleIndex bigint, level string, partialFingerprints map<string, string>,
      locations array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: bigint>>>>,
      suppressions array<struct<kind: string, justification: string>>"""
    items = _written_items(c, documents.sarif_items(c.stored.findings, ordered=True), "sarif", parsed)
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    suppression = F.get("r.suppressions", F.lit(0))
    return items.select(
        "source",
        "after_comma",
        F.col("r.ruleId").alias("rule_id"),
        F.col("r.ruleIndex").alias("rule_index"),
        F.col("r.level").alias("level"),
        place["artifactLocation"]["uri"].alias("uri"),
        place["region"]["startLine"].alias("start_line"),
        F.col("r.partialFingerprints")[V.FINGERPRINT_KEY].alias("fingerprint"),
        suppression["kind"].alias("kind"),
        suppression["justification"].alias("justification"),
    )


@query("s9_sarif_documents")
def s9_sarif_documents(c: Context) -> DataFrame:
    return documents.sarif_document(c.stored.reports, c.stored.findings).select("source", "part", "rule_ord", "line", "text")


@query("s10_combined_document")
def s10_combined_document(c: Context) -> DataFrame:
    return digest.combined_document(c.stored.findings, c.stored.reports, "2026-04-19")


_COUNTERS = ("files_scanned", "critical", "high", "medium", "low", "total", "exempted")
_GLOBAL = ("files_scanned", "total_findings", "critical", "high", "medium", "low")


@query(
    "s10_combined_fields",
    O.from_reports(
        "SELECT '' AS source, 'projects' AS field, CAST(count(*) AS VARCHAR) AS value FROM reports"
        + "".join(
            f" UNION ALL SELECT '', '{n}', CAST(sum({n.replace('total_findings', 'total')}) AS VARCHAR) FROM reports" for n in _GLOBAL
        )
        + " UNION ALL SELECT '', 'threat ' || quantum_threat, CAST(count(*) AS VARCHAR) FROM findings WHERE status <> 'exempted' GROUP BY quantum_threat"
        + """ UNION ALL SELECT '', 'algorithm ' || CAST(row_number() OVER (ORDER BY n DESC, algorithm) AS VARCHAR), algorithm || ' ' || CAST(n AS VARCHAR)
               FROM (SELECT algorithm, CAST(sum("count") AS BIGINT) AS n FROM alg GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)"""
        + "".join(
            f" UNION ALL SELECT '', '{name} {f}', CAST(count(*) FILTER (verdict = '{v}') AS VARCHAR) FROM reports"
            for f in ("nis2", "dora")
            for name, v in (("non_compliant", "NON-COMPLIANT"), ("at_risk", "AT RISK"), ("compliant", "COMPLIANT"))
        )
        + "".join(f" UNION ALL SELECT source, '{n}', CAST({n} AS VARCHAR) FROM reports" for n in _COUNTERS)
        + " UNION ALL SELECT source, 'nis2', verdict FROM reports"
        + " UNION ALL SELECT r.source, 'top_algorithm', coalesce(b.algorithm, 'n/a') FROM reports r LEFT JOIN best b ON r.source = b.source"
        + f""" UNION ALL SELECT source, 'finding ' || CAST(nth AS VARCHAR), rule_id || ' ' || file || ' ' || CAST(line AS VARCHAR) || ' ' || severity
               FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_RANK}, {_SEQ}) AS nth FROM findings WHERE status = 'active')
               WHERE nth <= 5""",
        _ALG,
        _BEST,
    ),
)
def s10_combined_fields(c: Context) -> DataFrame:
    """Every value of the combined document, parsed from its written fragments: the global part and all projects."""
    folder = shared_directory(c.spark, f"combined-{uuid4().hex}")
    digest.combined_document(c.stored.findings, c.stored.reports, "2026-04-19").write.parquet(folder)
    parts = c.spark.read.parquet(folder)

    def fields(frame: DataFrame, source: Column, values: dict) -> DataFrame:
        pairs = [x for name, value in values.items() for x in (F.lit(name), value.cast("string"))]
        return frame.select(source.alias("source"), F.stack(F.lit(len(values)), *pairs).alias("field", "value"))

    summary = ", ".join(f"{n}_{f}: bigint" for f in ("nis2", "dora") for n in ("non_compliant", "at_risk", "compliant"))
    head = f"""meta struct<projects_count: bigint>, `global` struct<{", ".join(f"{n}: bigint" for n in _GLOBAL)},
      by_quantum_threat: map<string, bigint>, top_algorithms: array<struct<algorithm: string, count: bigint>>,
      compliance_summary: struct<{summary}>>"""
    top = parts.where("part = 0").select(F.from_json(F.concat("text", F.lit("]}")), head).alias("r")).select("r.*")
    g = F.col("global")
    values = {"projects": F.col("meta.projects_count")} | {n: g[n] for n in _GLOBAL}
    values |= {f"{n} {f}": g["compliance_summary"][f"{n}_{f}"] for f in ("nis2", "dora") for n in ("non_compliant", "at_risk", "compliant")}
    nowhere = F.lit("")
    threats = top.select(F.explode(g["by_quantum_threat"]).alias("threat", "n"))
    algorithms = top.select(F.posexplode(g["top_algorithms"]).alias("i", "a"))
    item = f"""source string, files_scanned bigint, risk_summary struct<{", ".join(f"{n}: bigint" for n in _COUNTERS[1:])}>,
      compliance struct<nis2: string>, top_findings array<struct<rule_id: string, file: string, line: bigint, severity: string>>,
      top_algorithm string"""
    body = F.regexp_replace("text", r"\A,", "")
    projects = parts.where("part = 1").select(F.from_json(body, item).alias("p")).select("p.*")
    own = {n: F.col("risk_summary")[n] for n in _COUNTERS[1:]} | {"files_scanned": F.col("files_scanned")}
    own |= {"nis2": F.col("compliance.nis2"), "top_algorithm": F.col("top_algorithm")}
    found = projects.select("source", F.posexplode("top_findings").alias("i", "f"))
    told = F.concat_ws(" ", "f.rule_id", "f.file", F.col("f.line").cast("string"), "f.severity")
    rows = [
        fields(top, nowhere, values),
        threats.select(nowhere.alias("source"), F.concat(F.lit("threat "), "threat").alias("field"), F.col("n").cast("string").alias("value")),
        algorithms.select(
            nowhere.alias("source"),
            F.concat(F.lit("algorithm "), (F.col("i") + 1).cast("string")).alias("field"),
            F.concat_ws(" ", "a.algorithm", F.col("a.count").cast("string")).alias("value"),
        ),
        fields(projects, F.col("source"), own),
        found.select("source", F.concat(F.lit("finding "), (F.col("i") + 1).cast("string")).alias("field"), told.alias("value")),
    ]
    return reduce(DataFrame.unionByName, rows)


@query(
    "s9_sarif_edges",
    O.from_reports(
        f"""SELECT x.source, CAST(x.rule_index AS BIGINT) AS rule_index, x.rule_id AS name, {case("x.severity", V.SARIF_LEVEL, "'note'")} AS level,
              x.message AS "text", 'security,cryptography,post-quantum,' || x.quantum_threat || ',' || x.primitive AS tags, x.composition AS flag
            FROM first x
            UNION ALL SELECT source, -1, 'report', verdict, critical || '/' || high || '/' || total || '/' || exempted, '', NULL FROM reports""",
        _FIRST,
    ),
)
def s9_sarif_edges(c: Context) -> DataFrame:
    """Rules of the written SARIF documents, from their heads, and the report's properties, from their tails."""
    folder = shared_directory(c.spark, f"sarif-{uuid4().hex}")
    fragments = documents.sarif_document(c.stored.reports, c.stored.findings)
    fragments.where("part <> 1").write.parquet(folder)
    edges = c.spark.read.parquet(folder)
    own = f"""struct<id: string, fullDescription: struct<text: string>, defaultConfiguration: struct<level: string>,
      properties: struct<tags: array<string>, {V.PROPERTY_NAMESPACE}: struct<composition: boolean>>>"""
    head = f"runs array<struct<tool: struct<driver: struct<rules: array<{own}>>>>>"
    parsed = edges.where("part = 0").select("source", F.from_json(F.concat("text", F.lit("]}]}")), head).alias("r"))
    rules = parsed.select("source", F.posexplode(F.col("r.runs")[0]["tool"]["driver"]["rules"]).alias("i", "x"))
    tail = f"""runs array<struct<properties: struct<{V.PROPERTY_NAMESPACE}: struct<compliance: struct<nis2: string>,
      riskSummary: struct<critical: string, high: string, total: string, exempted: string>>>>>"""
    closing = F.from_json(F.concat(F.lit('{"runs":[{"results":['), "text"), tail)
    ends = edges.where("part = 2").select("source", closing["runs"][0]["properties"][V.PROPERTY_NAMESPACE].alias("p"))
    described = rules.select(
        "source",
        F.col("i").cast("bigint").alias("rule_index"),
        F.col("x.id").alias("name"),
        F.col("x.defaultConfiguration.level").alias("level"),
        F.col("x.fullDescription.text").alias("text"),
        F.array_join("x.properties.tags", ",").alias("tags"),
        F.col("x.properties")[V.PROPERTY_NAMESPACE]["composition"].alias("flag"),
    )
    risk = F.concat_ws("/", *[F.col("p.riskSummary")[n] for n in ("critical", "high", "total", "exempted")])
    reports = ends.select(
        "source", F.lit(-1).cast("bigint").alias("rule_index"), F.lit("report").alias("name"), F.col("p.compliance.nis2").alias("level"),
        risk.alias("text"), F.lit("").alias("tags"), F.lit(None).cast("boolean").alias("flag"),
    )
    return described.unionByName(reports)


# -- diff --------------------------------------------------------------------

_SPACE_RUN = O.lit("[" + V.SPACE_CLASS + "]+")
_PRINT = f"sha256(rule_id || '|' || file || '|' || trim(regexp_replace(snippet, {_SPACE_RUN}, ' ', 'g')))"


def _previous(c: Context) -> DataFrame:
    """Every file also has an older state: its last line was not there yet."""
    content = F.col("content")
    older = c.corpus.withColumn("content", F.regexp_replace(content, r"\r?\n[^\n]*\n?\z", ""))
    return scan(older, c.pack, c.as_of, c.exemptions)


_OLDER = [
    O.CORPUS.replace("corpus AS MATERIALIZED", "newer AS MATERIALIZED"),
    "corpus AS MATERIALIZED (SELECT source, file, regexp_replace(content, '\\r?\\n[^\\n]*\\n?$', '') AS content FROM newer"
    " UNION ALL SELECT 'new:' || source, file, content FROM newer)",
    *O._STEPS[1:5],
    f"prints AS (SELECT DISTINCT replace(source, 'new:', '') AS source, starts_with(source, 'new:') AS newer, {_PRINT} AS"
    " fingerprint FROM matches)",
]


@query(
    "t2_compare_scans",
    O.with_steps(
        """SELECT source, fingerprint, CASE WHEN bool_and(newer) THEN 'new' WHEN NOT bool_or(newer) THEN 'fixed'
              ELSE 'unchanged' END AS change FROM prints GROUP BY source, fingerprint""",
        *_OLDER,
    ),
)
def t2_compare_scans(c: Context) -> DataFrame:
    return diff.compare(c.findings, _previous(c))


@query(
    "t2_new_findings",
    O.with_steps(
        f"""SELECT replace(m.source, 'new:', '') AS source, m.file, m.rule_id, CAST(m.line AS BIGINT) AS line FROM matches m
            WHERE starts_with(m.source, 'new:') AND NOT EXISTS (
              SELECT 1 FROM prints p WHERE NOT p.newer AND p.source = replace(m.source, 'new:', '')
                AND p.fingerprint = {_PRINT.replace("rule_id", "m.rule_id").replace("file", "m.file").replace("snippet", "m.snippet")})""",
        *_OLDER,
    ),
)
def t2_new_findings(c: Context) -> DataFrame:
    return _big(diff.new_findings(c.findings, _previous(c)), "line").select("source", "file", "rule_id", "line")
