"""The planted corpus and the scan in SQL, written independently of the Spark plan.

Lines become rows, annotation targets come from a window over them, and every
match is a join, which is the textbook form of what the Spark job does inside rows.
"""

from __future__ import annotations

from pathlib import Path

import yaml

from contract import planted as P
from shorewatch import values as V

AS_OF = f"TIMESTAMP '{P.AS_OF}'"
NOT_SPACE = f"[^{V.SPACE_CLASS}]"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def case(subject: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {subject} {whens} ELSE {default} END"


def nonblank(column: str) -> str:
    return f"regexp_matches({column}, {lit(NOT_SPACE)})"


def _definitions() -> list[dict]:
    """All rule definitions as their authors wrote them, in the order of layers, files and places; nothing merged."""
    bundled = yaml.safe_load((Path(V.__file__).parent / "rulepacks" / "bundled.yaml").read_text("utf-8"))
    return [*bundled, *P.HOUSE_RULES, *P.TEAM_RULES]


_RULE_TEXTS = ("id", "language", "algorithm", "severity", "message", "migration", "quantum_threat", "primitive")

DERIVED_SEVERITY = (
    "CASE WHEN severity <> '' THEN severity WHEN quantum_threat = 'pqc-broken' THEN 'CRITICAL'"
    " WHEN quantum_threat = 'shor-broken' AND primitive IN ('asymmetric-encryption', 'key-exchange') THEN 'CRITICAL'"
    " WHEN quantum_threat IN ('shor-broken', 'classical-broken') THEN 'HIGH'"
    " WHEN quantum_threat IN ('grover-safe', 'pqc-standardized') THEN 'INFO'"
    " WHEN quantum_threat = 'pqc-experimental' THEN 'LOW' ELSE 'MEDIUM' END"
)


def layered_values() -> str:
    rows = [
        f"({n}, {', '.join(lit(str(rule.get(field) or '')) for field in _RULE_TEXTS)}, {bool(rule.get('composition'))})"
        for n, rule in enumerate(_definitions())
    ]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v(definition, {', '.join(_RULE_TEXTS)}, composition)"


def rule_match(line: str) -> str:
    whens = " ".join(f"WHEN {n} THEN regexp_matches({line}, {lit(r['pattern'])})" for n, r in enumerate(_definitions()))
    return f"CASE r.definition {whens} END"


EXT_LANG = {**{e: g for e, g in V.EXTENSIONS.items()}, ".rb": "ruby", ".rake": "ruby"}

SOURCE = (
    "CASE WHEN {k} % 3 = 0 THEN 'acme/monorepo' "
    "ELSE 'org' || CAST({k} % 7 AS VARCHAR) || '/repo-' || CAST({k} AS VARCHAR) END"
)

_PICKS = [
    f"tpl[base + 1 + ({a} * l_orderkey + {b} * l_partkey + {c} * l_suppkey + {d} * n) % {P.PER_LANGUAGE}]"
    for a, b, c, d in P.MIX
]


def _joined(separator: str) -> str:
    return f" || {separator} || ".join(_PICKS)


LF, CRLF = "chr(10)", "(chr(13) || chr(10))"

CORPUS = f"""
templates AS MATERIALIZED (SELECT {strings(P.TEMPLATES)} AS tpl),
corpus AS MATERIALIZED (
  SELECT {SOURCE.format(k="l_suppkey")} AS source,
         {strings(P.DIRECTORIES)}[1 + (l_partkey + 3 * l_suppkey) % {len(P.DIRECTORIES)}]
           || 'F' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(n AS VARCHAR) || '_' || CAST(l_partkey AS VARCHAR)
           || '_' || CAST(l_suppkey AS VARCHAR) || '_' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)
           || {strings(e for e, _ in P.EXTENSIONS)}[kind + 1] AS file,
         CASE WHEN l_orderkey % 5 = 0 THEN {_joined(CRLF)} ELSE {_joined(LF)} END
           || CASE WHEN l_suppkey % 2 = 0 THEN CASE WHEN l_orderkey % 5 = 0 THEN {CRLF} ELSE {LF} END ELSE '' END
           AS content
  FROM (SELECT *, CAST(l_linenumber AS BIGINT) AS n,
               (l_orderkey + l_linenumber) % {len(P.EXTENSIONS)} AS kind,
               [{", ".join(str(lang * P.PER_LANGUAGE) for _, lang in P.EXTENSIONS)}]
                 [1 + (l_orderkey + l_linenumber) % {len(P.EXTENSIONS)}] AS base
        FROM lineitem), templates
)"""

SELECTED = f"""
ext_map AS (SELECT * FROM (VALUES {", ".join(f"({lit(e)}, {lit(g)})" for e, g in EXT_LANG.items())}) AS v(ext, lang)),
selected AS MATERIALIZED (
  SELECT c.source, c.file, c.content, m.lang
  FROM corpus c JOIN ext_map m ON lower(regexp_extract(c.file, '(\\.[^./]*)$', 1)) = m.ext
  WHERE NOT list_has_any(string_split(c.file, '/')[:-2], {strings(V.SKIPPED_DIRECTORIES)})
)"""


def lines_of(table: str, columns: str = "source, file") -> str:
    """Line rows of ``table(…, content)``."""
    return f"""
  SELECT {columns}, line_no,
         CASE WHEN ends_with(raw, chr(13)) THEN left(raw, length(raw) - 1) ELSE raw END AS line
  FROM (SELECT {columns}, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS raw
        FROM (SELECT {columns}, CASE WHEN ends_with(content, chr(10)) OR content = ''
                     THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END AS parts
              FROM {table}))"""


LINES = f"""
lines AS MATERIALIZED ({lines_of("selected", "source, file, lang")}),
file_lines AS MATERIALIZED (
  SELECT source, file, list(line ORDER BY line_no) AS ls FROM lines GROUP BY ALL
)"""

# The last definition of an id holds, at the place of the first.
RULES = f"""layered AS ({layered_values()}),
rules AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY place) - 1 AS rule_ord, definition, id AS rule_id, language, algorithm,
         {DERIVED_SEVERITY} AS severity, message, migration, quantum_threat, primitive, composition
  FROM (SELECT *, min(definition) OVER (PARTITION BY id) AS place,
               row_number() OVER (PARTITION BY id ORDER BY definition DESC) AS nth FROM layered) WHERE nth = 1
)"""

MATCHES = f"""
rule_langs AS (SELECT r.*, l.lang FROM rules r JOIN (SELECT DISTINCT lang FROM ext_map) l
               ON r.language = '' OR r.language = l.lang),
matches AS MATERIALIZED (
  SELECT l.source, l.file, l.line_no AS line, r.* EXCLUDE (lang, language, definition), l.line AS text,
         array_to_string(f.ls[greatest(l.line_no - 2, 1):greatest(l.line_no - 2, 1) + 4], chr(10)) AS snippet
  FROM lines l JOIN rule_langs r ON l.lang = r.lang AND {rule_match("l.line")}
  JOIN file_lines f ON f.source = l.source AND f.file = l.file
)"""

_REASON = [f"regexp_extract(line, {lit(V.ANNOTATION_REASON_PATTERN)}, {g})" for g in (1, 2, 3)]


def notes_of(lines: str) -> str:
    return f"""
  SELECT source, file, line_no, target_line, rule_id, reason, until FROM (
    SELECT source, file, line_no, line,
           min(CASE WHEN {nonblank("line")} THEN line_no END) OVER (PARTITION BY source, file ORDER BY line_no
             ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS target_line,
           regexp_extract(line, {lit(V.ANNOTATION_RULE_PATTERN)}, 1) AS rule_id,
           coalesce(nullif({_REASON[0]}, ''), nullif({_REASON[1]}, ''), {_REASON[2]}) AS reason,
           regexp_extract(line, {lit(V.ANNOTATION_UNTIL_PATTERN)}, 1) AS until
    FROM {lines})
  WHERE regexp_matches(line, {lit(V.MARKER_PATTERN)}) AND {nonblank("reason")} AND target_line IS NOT NULL"""


def status_of(until: str) -> str:
    return (
        f"CASE WHEN {AS_OF} > try_strptime(CASE WHEN regexp_matches({until}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN {until} END, '%Y-%m-%d') "
        f"THEN 'expired-exemption' ELSE 'exempted' END"
    )


INLINE = f"""
notes AS MATERIALIZED ({notes_of("lines")}),
inline_findings AS MATERIALIZED (
  SELECT m.*, CASE WHEN n.reason IS NULL THEN 'active' ELSE {status_of("n.until")} END AS status,
         n.reason AS ex_reason, CAST(NULL AS VARCHAR) AS ex_owner, nullif(n.until, '') AS ex_until,
         CASE WHEN n.reason IS NOT NULL THEN 'inline' END AS ex_source
  FROM matches m LEFT JOIN notes n
    ON m.source = n.source AND m.file = n.file AND m.line = n.target_line
   AND (n.rule_id = '' OR n.rule_id = m.rule_id)
)"""

# The globs of the planted exemption entries as regular expressions, by entry.
GLOBS = {
    0: r"^src/(.*/)?vault(/.*)?$",
    2: r"^a/[^/]*$",
    3: r"^(.*/)?F1[^/]*$",
    4: r"^services/(.*/)?[^/]*\.java$",
    5: r"^(.*/)?F[^/]_[^/]*\.go$",
}

_ENTRIES = " UNION ALL ".join(
    f"SELECT source, {i} AS ord, {lit(rule)} AS rule, {lit(path)} AS path, {lit(reason)} AS reason, "
    f"{lit(owner)} AS owner, {lit(until)} AS until FROM repositories WHERE key % {m} = {r}"
    for i, (m, r, rule, path, reason, owner, until) in enumerate(P.EXEMPTION_ENTRIES)
)

EXEMPTIONS = f"""
repositories AS (SELECT {SOURCE.format(k="s_suppkey")} AS source, min(s_suppkey) AS key FROM supplier GROUP BY 1),
entries AS MATERIALIZED ({_ENTRIES}),
valid_entries AS MATERIALIZED (
  SELECT * FROM entries WHERE source NOT IN (SELECT source FROM entries WHERE NOT {nonblank("reason")})
)"""

_GLOB = "CASE e.ord " + " ".join(f"WHEN {i} THEN regexp_matches(i.file, {lit(g)})" for i, g in GLOBS.items()) + " ELSE true END"

FINDINGS = f"""
config_hits AS (
  SELECT i.source, i.file, i.rule_ord, i.line, e.reason, e.owner, e.until,
         row_number() OVER (PARTITION BY i.source, i.file, i.rule_ord, i.line ORDER BY e.ord) AS nth
  FROM inline_findings i JOIN valid_entries e ON i.source = e.source
   AND (e.rule = '' OR e.rule = i.rule_id) AND {_GLOB}
  WHERE i.status = 'active'
),
findings AS MATERIALIZED (
  SELECT i.source, i.file, i.rule_ord, i.rule_id, i.line, 0 AS "column", i.algorithm, i.severity, 8 AS confidence,
         i.snippet, i.message, i.migration, i.quantum_threat, i.primitive, i.composition,
         CASE WHEN h.reason IS NULL THEN i.status ELSE {status_of("h.until")} END AS status,
         coalesce(h.reason, i.ex_reason) AS ex_reason,
         coalesce(nullif(h.owner, ''), i.ex_owner) AS ex_owner,
         CASE WHEN h.reason IS NULL THEN i.ex_until ELSE nullif(h.until, '') END AS ex_until,
         CASE WHEN h.reason IS NULL THEN i.ex_source ELSE 'config' END AS ex_source
  FROM inline_findings i LEFT JOIN config_hits h
    ON h.nth = 1 AND i.source = h.source AND i.file = h.file AND i.rule_ord = h.rule_ord AND i.line = h.line
)"""

REPORTS = """
risk AS MATERIALIZED (
  SELECT source,
         count(*) FILTER (severity = 'CRITICAL' AND status <> 'exempted') AS critical,
         count(*) FILTER (severity = 'HIGH' AND status <> 'exempted') AS high,
         count(*) FILTER (severity = 'MEDIUM' AND status <> 'exempted') AS medium,
         count(*) FILTER (severity = 'LOW' AND status <> 'exempted') AS low,
         count(*) FILTER (severity = 'INFO' AND status <> 'exempted') AS info,
         count(*) FILTER (severity = 'SAFE' AND status <> 'exempted') AS safe,
         count(*) AS total,
         count(*) FILTER (status = 'exempted') AS exempted,
         count(*) FILTER (status = 'active') AS active
  FROM findings GROUP BY source
),
scanned AS (
  SELECT c.source, count(s.file) AS files_scanned
  FROM corpus c LEFT JOIN selected s ON c.source = s.source AND c.file = s.file GROUP BY 1
),
reports AS MATERIALIZED (
  SELECT s.source, s.files_scanned, (SELECT count(*) FROM rules) AS rules_applied,
         coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium,
         coalesce(low, 0) AS low, coalesce(info, 0) AS info, coalesce(safe, 0) AS safe,
         coalesce(total, 0) AS total, coalesce(exempted, 0) AS exempted, coalesce(active, 0) AS active,
         CASE WHEN coalesce(critical, 0) > 0 THEN 'NON-COMPLIANT' WHEN coalesce(high, 0) > 0 THEN 'AT RISK'
              ELSE 'COMPLIANT' END AS verdict
  FROM scanned s LEFT JOIN risk r USING (source)
)"""

TARGETS = f"""
targets AS MATERIALIZED (
  SELECT name, repo, {strings(P.CATEGORIES)}[1 + nation % {len(P.CATEGORIES)}] AS category,
         'Repository of ' || name AS description
  FROM (SELECT {SOURCE.format(k="s_suppkey")} AS repo, min(s_suppkey) AS key, arg_min(s_name, s_suppkey) AS name,
               arg_min(s_nationkey, s_suppkey) AS nation FROM supplier GROUP BY 1)
  WHERE key % 13 <> 0 OR key = 0
)"""

_STEPS = [CORPUS, SELECTED, LINES, RULES, MATCHES, INLINE, EXEMPTIONS, FINDINGS, REPORTS]


def with_steps(body: str, *steps: str) -> str:
    return "WITH " + ",".join(steps) + "\n" + body


def from_corpus(body: str) -> str:
    return with_steps(body, CORPUS)


def from_selected(body: str) -> str:
    return with_steps(body, CORPUS, SELECTED)


def from_lines(body: str) -> str:
    return with_steps(body, CORPUS, SELECTED, LINES)


def from_matches(body: str) -> str:
    return with_steps(body, *_STEPS[:5])


def from_inline(body: str) -> str:
    return with_steps(body, *_STEPS[:6])


def from_findings(body: str) -> str:
    return with_steps(body, *_STEPS[:8])


def from_reports(body: str, *more: str) -> str:
    return with_steps(body, *_STEPS, *more)
