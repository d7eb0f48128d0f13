"""What a query scans, writes and sends to the driver."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from contract import planted
from shorewatch import values as V
from shorewatch.functions import text
from shorewatch.operators import salting, tables
from shorewatch.operators.salting import salted_join
from shorewatch.plans import jobs
from shorewatch.sinks import documents
from shorewatch.sinks.documents import with_rule_index, write_documents
from shorewatch.operators.scan import raw_findings
from shorewatch.sources.rules import RulePack, _clean, bundled_rules, table

HOUSE = RulePack.layered(bundled_rules(), [_clean(r) for r in planted.HOUSE_RULES])
SF = "/root/testdata/sf0.001"


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_both_maps_of_a_summary_take_one_scan(spark):
    assert _plan(contract.queries()["a2_risk_summary_maps"](spark, SF)).count("lineitem.parquet") == 1


@pytest.mark.parametrize("name", ["a7_file_listing", "s14_view_model", "a16_report_positions"])
def test_findings_are_written_without_unread_columns(spark, monkeypatch, name):
    written = {}

    def kept(frame, path, write=jobs._written):
        written[os.path.basename(path)] = frame.columns
        return write(frame, path)

    monkeypatch.setattr(jobs, "_written", kept)
    assert contract.queries()[name](spark, SF).count()
    assert "file" in written["findings"] and not {"snippet", "message", "exemption"} & set(written["findings"])


def test_copies_of_lists_are_not_broadcast(spark):
    findings = table(spark, [{"source": s, "file": f"f{i}"} for i, s in enumerate("aabn")], "source string, file string")
    lists = table(spark, [{"source": s, "x": i} for i, s in enumerate("ab")], "source string, x int")
    joined = salted_join(findings, lists, ["source"], max_bytes=0)
    assert "Broadcast" not in _plan(joined)
    assert sorted(map(tuple, joined.collect())) == [("a", "f0", 0), ("a", "f1", 0), ("b", "f2", 1)]


def test_rule_indexes_with_gaps(spark):
    findings = table(spark, [{"source": s, "rule_id": r, "file": "f"} for s in "abc" for r in ("x", "y", "z", None)], "source string, rule_id string, file string")
    rules = table(
        spark, [{"source": s, "rule_id": r, "rule_index": i} for s, r, i in (("a", "y", 5), ("a", "x", 2), ("a", None, 0), ("b", "z", 0))],
        "source string, rule_id string, rule_index int",
    )
    indexed = with_rule_index(findings, rules)
    assert indexed.columns == [*findings.columns, "rule_index"] and indexed.schema["rule_index"].dataType == rules.schema["rule_index"].dataType
    assert sorted((r.source, r.rule_id, r.rule_index) for r in indexed.collect()) == [("a", "x", 2), ("a", "y", 5), ("b", "z", 0)]


def test_scans_are_compared_without_what_a_fingerprint_lacks(spark):
    for name, shuffles in (("t2_compare_scans", 1), ("t2_new_findings", 2)):
        plan = _plan(contract.queries()[name](spark, SF))
        # The exchanges of the corpus and of the lists are of their own.
        assert plan.count("fingerprint") and len([x for x in plan.split("\n") if "Exchange hashpartitioning(source#" in x and "fingerprint" in x]) == shuffles
        # No exemption is looked up: neither status nor reason are part of what is compared.
        assert "lambda e#" not in plan


def test_an_entry_is_looked_up_once(spark):
    plan = _plan(contract.queries()["s15_project_page"](spark, SF))
    assert plan.count("filter(_list#") == 1


def test_documents_are_compressed_at_the_least_level(spark, tmp_path):
    import zlib

    rows = [{"source": "s", "text": "".join(f'{{"rule_id":"r{i * j % 7}","file":"a/{i * j * 7919 % 10007}.go","line":{j}}}' for j in range(20))} for i in range(400)]
    frame = table(spark, rows, "source string, text string").coalesce(1)
    write_documents(frame, str(tmp_path / "out"), "gzip", ordered=True)
    (file,) = (tmp_path / "out").rglob("part-*.gz")
    content = zlib.decompress(file.read_bytes(), 31)
    sizes = [len(zlib.compress(content, level)) for level in (1, 6)]
    assert content.decode().splitlines() == [r["text"] for r in rows] and abs(file.stat().st_size - sizes[0]) < abs(file.stat().st_size - sizes[1])


def test_lines_above_single_and_adjacent_blank_lines(spark):
    key, note = "-----BEGIN RSA PRIVATE KEY-----", f"# {V.MARKER} reason=r"
    parts = [[], [""], [" \t"], ["", ""], ["x", ""], ["", "x"], ["　", "\x0b"], [note], [note, ""], [note, "", " "], ["", note, ""]]
    texts = [end.join([*a, *b, key, *c, key, note]) + tail for a in parts for b in parts for c in parts for end in ("\n", "\r\n") for tail in ("", end)]
    files = table(spark, [{"source": "s", "file": f"{i}.py", "content": t} for i, t in enumerate(texts)], "source string, file string, content string")
    found = raw_findings(files, HOUSE, F.lit("2026-04-19 12:00:00+00:00").cast("timestamp")).select("file", "line", "status").collect()
    want = {}
    for i, content in enumerate(texts):
        lines = [x.removesuffix("\r") for x in content.split("\n")]
        for n, line in enumerate(lines):
            above = next((x for x in reversed(lines[:n]) if x.strip()), None)
            if line == key:
                want[f"{i}.py", n + 1] = V.EXEMPTED if above == note else V.ACTIVE
    assert {(r.file, r.line): r.status for r in found} == want and len(found) == len(want)
    check = table(spark, [{"c": c} for c in ("a\n\nb\n", "a\n \r\nb", "a\n\n\nb", "\na", "a\n \n\t\nb")], "c string")
    assert [r[0] for r in check.select(text.has_blank_lines_together(F.col("c"))).collect()] == [False, False, True, True, True]


def test_rules_are_tried_by_compiled_code_once(spark):
    plan = _plan(contract.queries()["a4_totals"](spark, SF))
    assert "filter(CASE" not in plan and plan.count("array_remove(") == 1


def test_documents_look_at_findings_once_before_their_items(spark, monkeypatch):
    # All about rules, and the first finding of each source, comes from that look.
    looks = []

    def kept(frame, name, write=tables.written):
        looks.append(_plan(frame).count("findings-"))
        return write(frame, name)

    for module in (documents, salting):
        monkeypatch.setattr(module, "written", kept)
    contract.queries()["s9_sarif_documents"](spark, SF)
    assert sum(looks) == 1
