"""Items of documents are brought in their order before they are texts."""

from pyspark.sql import functions as F

from shorewatch import model
from shorewatch.operators.rollup import report_rows
from shorewatch.sinks.documents import report_document, report_items, sarif_document, sarif_items, write_documents
from shorewatch.sources.rules import RulePack, bundled_rules, table


def _findings(spark):
    rows = [
        {"source": s, "file": f, "rule_ord": o, "rule_id": f"r{o}", "line": n, "column": 0, "severity": "HIGH", "snippet": f, "message": "m", "status": "active"}
        for s in ("a", "b") for f in ("x/b.go", "x.go", "é.go") for o in (1, 0) for n in (12, 3)
    ]
    return table(spark, rows, model.FINDINGS)


def test_ordered_items_are_those_of_the_documents(spark, tmp_path):
    findings = _findings(spark)
    reports = report_rows(findings.withColumn("content", F.lit("")), findings, RulePack(bundled_rules()), report_id=F.col("source"))
    for n, (document, items) in enumerate(((report_document, report_items), (sarif_document, sarif_items))):
        want = sorted((r.source, r.segs, r.rule_ord, r.line, r.text) for r in document(reports, findings).where("part = 1").collect())
        found = items(findings, ordered=True)
        assert sorted((r.source, r.segs, r.rule_ord, r.line, r.text) for r in found.collect()) == want
        plan = found._jdf.queryExecution().analyzed().toString()
        assert plan.index("to_json") < plan.index("RepartitionByExpression")
        write_documents(found, str(tmp_path / f"{n}"), ordered=True)
        for source in ("a", "b"):
            parts = sorted((tmp_path / f"{n}" / f"source={source}").glob("part-*"))
            assert "".join(p.read_text() for p in parts).splitlines() == [t for s, *_, t in want if s == source]
