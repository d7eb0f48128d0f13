"""Lists beside findings: short exemption lists without trees, and rows of a source without a shuffle of findings."""

import pytest
from pyspark.sql import functions as F

from shorewatch import model
from shorewatch import values as V
from shorewatch.operators import exemptions as ops
from shorewatch.operators.exemptions import apply_config
from shorewatch.operators.salting import salted_join
from shorewatch.sinks.documents import with_rule_index, write_documents
from shorewatch.sources.reports import read_report_documents
from shorewatch.sources.rules import table

AS_OF = "2026-04-19 12:00:00+00:00"


def _entry(source, ord, rule, path, reason, until=""):
    return {"source": source, "ord": ord, "rule": rule, "path": path, "reason": reason, "owner": "", "until": until}


@pytest.mark.parametrize("collect_bytes", [8 << 20, 0])
def test_short_lists_need_no_trees(spark, monkeypatch, collect_bytes):
    monkeypatch.setattr(ops, "_looked_up", None)
    monkeypatch.setattr(ops, "matched_entries", None)
    entries = [
        _entry("a", 1, "", "src/**", "second"), _entry("a", 0, "r1", "src/**/x?.go", "first"), _entry("a", 2, "", "", "rest", "2020-01-01"),
        _entry("b", 0, "", "src", "only"), _entry("void", 0, "", "", " "),
    ]
    cases = [
        ("a", "src/x1.go", "r1", "first"), ("a", "src/d/x1.go", "r1", "first"), ("a", "src/d/x1.go", "r2", "second"), ("a", "src", "r1", "second"),
        ("a", "srcs/x1.go", "r1", "rest"), ("a", "src/d/xé.go", "r1", "first"), ("a", "src/" + "d/" * 20_000 + "x1.go", "r1", "first"),
        ("b", "src", "r1", "only"), ("b", "src/x", "r1", None), ("void", "src", "r1", None), ("none", "src", "r1", None), ("a", None, "r1", None),
    ]
    rows = [{"source": s, "file": f, "rule_id": r, "line": i, "status": V.ACTIVE} for i, (s, f, r, _) in enumerate(cases)]
    rows.append({"source": "a", "file": "src/x1.go", "rule_id": "r1", "line": 99, "status": V.EXEMPTED})
    found = apply_config(
        table(spark, rows, model.FINDINGS), table(spark, entries, model.CONFIG_EXEMPTIONS), F.lit(AS_OF).cast("timestamp"), collect_bytes
    )
    got = {r.line: (r.status, r.exemption and r.exemption.reason) for r in found.collect()}
    status = {None: V.ACTIVE, "rest": V.EXPIRED}
    assert got == {i: (status.get(want, V.EXEMPTED), want) for i, (*_, want) in enumerate(cases)} | {99: (V.EXEMPTED, None)}


def test_small_lists_leave_findings_where_they_are(spark):
    findings = table(spark, [{"source": s, "file": f"f{i}"} for i, s in enumerate("aabn")], "source string, file string")
    lists = table(spark, [{"source": s, "x": i} for i, s in enumerate("ab")], "source string, x int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small, large = salted_join(findings, lists, ["source"]), salted_join(findings, lists, ["source"], max_bytes=0)
        plan = small._jdf.queryExecution().simpleString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert "SortMergeJoin" in large._jdf.queryExecution().simpleString()
        want = [("a", "f0", 0), ("a", "f1", 0), ("b", "f2", 1)]
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rule_index_of_a_source(spark):
    findings = table(spark, [{"source": s, "file": "f", "rule_id": r} for s, r in ("ax", "ay", "bx", "a-", "cx")], "source string, file string, rule_id string")
    rules = table(
        spark, [{"source": s, "rule_id": r, "rule_index": i} for s, r, i in (("a", "y", 0), ("a", "x", 1), ("b", "x", 0), ("b", None, 1))],
        "source string, rule_id string, rule_index int",
    )
    got = sorted((r.source, r.rule_id, r.rule_index) for r in with_rule_index(findings, rules).collect())
    assert got == [("a", "x", 1), ("a", "y", 0), ("b", "x", 0)]


def test_compressed_documents_are_read_back(spark, tmp_path):
    text = [(0, '{"id":"1","source":"a","findings":['), (1, '{"rule_id":"r","file":"f","line":3}'), (2, '],"risk_summary":{"total":1}}')]
    rows = [{"source": "a", "part": p, "segs": [], "rule_ord": 0, "line": 0, "text": t} for p, t in text]
    folder = str(tmp_path / "docs")
    write_documents(table(spark, rows, "source string, part int, segs array<string>, rule_ord int, line int, text string"), folder, "gzip")
    assert list((tmp_path / "docs").rglob("part-*.gz")) and not list((tmp_path / "docs").rglob("part-*.txt"))
    reports, findings = read_report_documents(spark, folder)
    assert [(r.source, r.problem, r.risk_summary.total) for r in reports.collect()] == [("a", None, 1)]
    assert [(f.source, f.seq, f.rule_id, f.line) for f in findings.collect()] == [("a", 0, "r", 3)]
