"""Schemas shared by readers, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(*pairs) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


S, I, L, B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()

FILES = _fields(("source", S), ("file", S), ("content", S))

RULE_FIELDS = [
    ("id", S),
    ("language", S),
    ("extensions", T.ArrayType(S)),
    ("pattern", S),
    ("algorithm", S),
    ("severity", S),
    ("message", S),
    ("migration", S),
    ("quantum_threat", S),
    ("primitive", S),
    ("composition", B),
]
RULES = _fields(("ord", I), *RULE_FIELDS)
LAYERED_RULES = _fields(("layer", I), ("file", S), ("pos", I), *RULE_FIELDS)

EXEMPTION = _fields(("reason", S), ("owner", S), ("until", S), ("source", S))
CONFIG_EXEMPTIONS = _fields(
    ("source", S), ("ord", I), ("rule", S), ("path", S), ("reason", S), ("owner", S), ("until", S)
)
TARGETS = _fields(("name", S), ("repo", S), ("category", S), ("description", S))

FINDING_FIELDS = [
    ("file", S),
    ("rule_ord", I),
    ("rule_id", S),
    ("line", I),
    ("column", I),
    ("algorithm", S),
    ("severity", S),
    ("confidence", I),
    ("snippet", S),
    ("message", S),
    ("migration", S),
    ("quantum_threat", S),
    ("primitive", S),
    ("composition", B),
    ("status", S),
    ("exemption", EXEMPTION),
]
FINDINGS = _fields(("source", S), *FINDING_FIELDS)
FINDING_COLUMNS = [name for name, _ in [("source", S), *FINDING_FIELDS]]

RISK = _fields(
    ("critical", L),
    ("high", L),
    ("medium", L),
    ("low", L),
    ("info", L),
    ("safe", L),
    ("total", L),
    ("exempted", L),
    ("by_quantum_threat", T.MapType(S, L)),
    ("by_primitive", T.MapType(S, L)),
)
COMPLIANCE = _fields(("nist_fips_203", S), ("nist_fips_204", S), ("nis2", S), ("dora", S))

# Reader schema of saved reports: the reserved AI fields are accepted, never filled.
REPORT_FINDING = _fields(
    *[(n, t) for n, t in FINDING_FIELDS if n != "rule_ord"],
    ("ai_risk", _fields(("severity", S), ("reasoning", S), ("data_lifetime", S))),
)
REPORT = _fields(
    ("id", S),
    ("source", S),
    ("ref", S),
    ("sha", S),
    ("scanned_at", T.TimestampType()),
    ("duration_ms", L),
    ("files_scanned", L),
    ("rules_applied", L),
    ("findings", T.ArrayType(REPORT_FINDING)),
    ("risk_summary", RISK),
    ("compliance", COMPLIANCE),
    ("ai_scoring", B),
)
