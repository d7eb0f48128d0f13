import json

from pyspark.sql import functions as F

from shorewatch import model
from shorewatch import values as V
from shorewatch.functions import sarif
from shorewatch.functions import severity as sev
from shorewatch.operators import portfolio, rollup
from shorewatch.operators.scan import scan
from shorewatch.plans.jobs import scan_corpus, scan_to_table, shared_directory
from shorewatch.sinks import digest, documents
from shorewatch.sources.exemptions import exemptions_from_checkouts
from shorewatch.sources.files import files_from_tree
from shorewatch.sources.reports import flatten, read_reports
from shorewatch.sources.rules import RulePack, bundled_rules, table
from shorewatch.sources.targets import targets_from_yaml

def now():
    return F.lit("2026-04-19 12:00:00+00:00").cast("timestamp")
M = V.MARKER

JAVA = """import javax.crypto.Cipher;

public class Example {
    void run() {
        KeyPairGenerator g = KeyPairGenerator.getInstance("RSA");
        // %s reason="legacy \\"interop\\""
        Cipher c = Cipher.getInstance("RSA/ECB");
    }
}
""" % M


def sample(spark):
    rows = [
        ("acme/app", "src/Example.java", JAVA),
        ("acme/app", "src/a/B.java", 'KeyPairGenerator.getInstance("EC");\n'),
        ("acme/app", "src/a.java", 'Signature.getInstance("SHA1withDSA"); // "é"\n'),
        ("acme/web", "index.ts", "const t = new SignJWT(x)\n"),
        ("acme/empty", "README.md", "nothing"),
    ]
    return table(spark, [{"source": s, "file": f, "content": c} for s, f, c in rows], model.FILES)


PACK = RulePack(bundled_rules())


def result(spark, **more):
    return scan_corpus(sample(spark), PACK, as_of=now(), report_id=F.lit("id-1"), ref="main", sha="abc", **more)


def joined(fragments, *order):
    """Documents by source; the test data is small."""
    out = {}
    for row in fragments.orderBy(*order).collect():
        out[row.source] = out.get(row.source, "") + row.text
    return out


def test_report_rows(spark):
    rows = {r.source: r for r in result(spark).reports.collect()}
    app = rows["acme/app"]
    assert (app.files_scanned, app.critical, app.high, app.total, app.exempted, app.active) == (3, 2, 1, 4, 1, 3)
    assert app.by_quantum_threat == {"shor-broken": 2, "classical-broken": 1}
    assert app.by_primitive == {"asymmetric-encryption": 1, "signature": 2}
    assert [rows[s].nis2 for s in ("acme/app", "acme/web", "acme/empty")] == ["NON-COMPLIANT", "COMPLIANT", "COMPLIANT"]
    assert (rows["acme/empty"].files_scanned, rows["acme/empty"].total) == (0, 0)
    failed = {m: {r.source for r in rollup.gate(result(spark).reports, m).where("failed").collect()} for m in V.FAIL_MODES}
    assert failed == {"critical": {"acme/app"}, "high": {"acme/app"}, "any": {"acme/app", "acme/web"}, "never": set()}


def test_canonical_documents_round_trip(spark, tmp_path):
    found, reports = result(spark)
    documents_by_source = joined(documents.report_document(reports, found), *documents.ORDER)
    parsed = {s: json.loads(t) for s, t in documents_by_source.items()}
    app = parsed["acme/app"]
    assert [(f["rule_id"], f["file"], f["line"]) for f in app["findings"]] == [
        ("java-rsa-keygen", "src/Example.java", 5),
        ("java-rsa-cipher", "src/Example.java", 7),
        ("java-ec-keygen", "src/a/B.java", 1),
        ("java-sha1-sig", "src/a.java", 1),
    ]
    assert app["scanned_at"] == "2026-04-19T12:00:00.000000Z" and app["ai_scoring"] is False
    assert app["findings"][1]["exemption"] == {"reason": 'legacy \\', "source": "inline"}
    assert "composition" not in app["findings"][0] and "exemption" not in app["findings"][0]
    assert parsed["acme/empty"]["findings"] == [] and "by_primitive" not in parsed["acme/empty"]["risk_summary"]
    for source, text in documents_by_source.items():
        (tmp_path / f"{source.replace('/', '-')}.json").write_text(text)
    back = read_reports(spark, str(tmp_path))
    assert portfolio.explode_reports(back).count() == 5
    totals = portfolio.global_totals(flatten(back)).first()
    assert (totals.projects_count, totals.total_findings, totals.critical) == (3, 5, 2)


def test_documents_on_disk_are_ordered(spark, tmp_path):
    found, reports = result(spark)
    documents.write_documents(documents.sarif_document(reports, found), str(tmp_path / "out"))
    folder = next(p for p in (tmp_path / "out").iterdir() if p.name.startswith("source=acme%2Fapp"))
    text = "".join(p.read_text() for p in sorted(folder.glob("part-*.txt")))
    assert len(json.loads(text)["runs"][0]["results"]) == 4


def test_sarif_documents(spark):
    found, reports = result(spark)
    fragments = documents.sarif_document(reports, found, "1.2", tool_uri="https://example.org")
    parsed = {s: json.loads(t) for s, t in joined(fragments, *documents.ORDER).items()}
    app = parsed["acme/app"]
    assert app["version"] == "2.1.0" and len(app["runs"]) == 1
    run = app["runs"][0]
    rules = [r["id"] for r in run["tool"]["driver"]["rules"]]
    assert rules == ["java-rsa-keygen", "java-rsa-cipher", "java-ec-keygen", "java-sha1-sig"]
    assert [r["ruleIndex"] for r in run["results"]] == [0, 1, 2, 3]
    assert [len(r.get("suppressions", [])) for r in run["results"]] == [0, 1, 0, 0]
    assert run["results"][1]["suppressions"][0]["kind"] == "inSource"
    assert run["results"][0]["level"] == "error"
    assert len(run["results"][0]["partialFingerprints"][V.FINGERPRINT_KEY]) == 64
    assert run["results"][0]["properties"][V.PROPERTY_NAMESPACE]["quantumThreat"] == "shor-broken"
    region = run["results"][0]["locations"][0]["physicalLocation"]["region"]
    assert region["startLine"] == 5 and region["startColumn"] == 1
    assert run["tool"]["driver"]["rules"][0]["properties"]["tags"][-1] == "asymmetric-encryption"
    assert parsed["acme/empty"]["runs"][0]["results"] == [] and parsed["acme/empty"]["runs"][0]["tool"]["driver"]["rules"] == []


def test_fingerprint_ignores_lines_and_spacing(spark):
    frame = table(
        spark,
        [{"s": 'x := "RSA"\n  y'}, {"s": ' x  :=\t"RSA" y\n'}, {"s": 'x := "RSA" z'}],
        "s string",
    )
    prints = [r[0] for r in frame.select(sarif.fingerprint(F.lit("r"), F.lit("a.go"), F.col("s"))).collect()]
    assert prints[0] == prints[1] != prints[2]


def test_levels(spark):
    frame = table(spark, [{"s": s} for s in [*V.SEVERITIES, "ODD"]], "s string")
    got = {r.s: (r.a, r.b, r.c) for r in frame.select("s", sev.sarif_level(F.col("s")).alias("a"), sev.ci_level(F.col("s")).alias("b"), sev.rank(F.col("s")).alias("c")).collect()}
    assert got["CRITICAL"] == got["HIGH"][:2] + (4,) == ("error", "error", 4)
    assert got["MEDIUM"] == ("warning", "warning", 2)
    assert {got[s][:2] for s in ("LOW", "INFO", "SAFE", "ODD")} == {("note", "notice")}


def test_combined_document(spark):
    found, reports = scan_to_table(
        sample(spark), PACK, shared_directory(spark, "combined"), as_of=now(), report_id=F.lit("id")
    )
    rows = digest.combined_document(found, reports, "2026-04-19").orderBy("part", "slug", "source").collect()
    combined = json.loads("".join(r.text for r in rows))
    assert combined["meta"]["projects_count"] == 3 and combined["global"]["total_findings"] == 5
    assert combined["global"]["by_quantum_threat"] == {"classical-broken": 1, "shor-broken": 3}
    assert combined["global"]["compliance_summary"]["non_compliant_nis2"] == 1
    assert [p["source"] for p in combined["projects"]] == ["acme/app", "acme/empty", "acme/web"]
    assert combined["projects"][1]["top_findings"] == [] and combined["projects"][1]["top_algorithm"] == "n/a"
    assert [f["severity"] for f in combined["projects"][0]["top_findings"]] == ["CRITICAL", "CRITICAL", "HIGH"]
    assert combined["global"]["top_algorithms"][0]["count"] == 1


def test_tree_keeps_private_and_hidden_names(spark, tmp_path):
    names = ["pkg/a.py", "pkg/__init__.py", "_private.py", "_gen/b.py", ".github/c.py", "__tests__/d.js", "ok/.eslintrc.js"]
    for source in ("one", "two words"):
        for name in [*names, "build/no.py", "notes.txt", "pkg/.cache/no.py"]:
            (tmp_path / source / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / source / name).write_text(f"{source} {name}")
    (tmp_path / "loose.py").write_text("in no checkout")
    got = {(r.source, r.file): r.content for r in files_from_tree(spark, str(tmp_path), PACK, None).collect()}
    assert got == {(s, n): f"{s} {n}" for s in ("one", "two words") for n in names}
    assert {r.file for r in files_from_tree(spark, str(tmp_path / "one"), PACK).collect()} == set(names)


def test_broken_exemption_file_voids_its_own_list_only(spark, tmp_path):
    for source, document in {
        "good": "exemptions: [{path: 'a/**', reason: kept}]", "yaml": "exemptions: [", "shape": "exemptions: [text]", "list": "exemptions: 3",
    }.items():
        (tmp_path / source).mkdir()
        (tmp_path / source / V.CONFIG_FILE).write_text(document)
    lists = exemptions_from_checkouts(spark, {s: str(tmp_path / s) for s in ("good", "yaml", "shape", "list")})
    from shorewatch.operators.exemptions import valid_exemptions

    assert [r.source for r in valid_exemptions(lists).collect()] == ["good"]
    assert lists.where("source = 'yaml' AND owner LIKE 'unreadable%'").count() == 1


def test_sources_on_disk(spark, tmp_path):
    root = tmp_path / "my build" / "app"
    for path, content in {
        "src/A b.java": b'Cipher.getInstance("RSA") // \xff\n',
        "src/B.JAVA": b"x",
        "vendor/lib/C.java": b'Cipher.getInstance("RSA")',
        "notes.txt": b"RSA",
        V.CONFIG_FILE: b"exemptions:\n  - {rule: java-rsa-cipher, path: 'src/**', reason: test, until: 2099-01-01}\n",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    frame = files_from_tree(spark, str(root), PACK, "acme/app")
    assert sorted(r.file for r in frame.collect()) == ["src/A b.java", "src/B.JAVA"]
    lists = exemptions_from_checkouts(spark, {"acme/app": str(root), "acme/none": str(tmp_path)})
    got = scan(frame, PACK, now(), lists).collect()
    assert [(r.file, r.status, r.exemption.until) for r in got] == [("src/A b.java", "exempted", "2099-01-01")]
    assert "�" in got[0].snippet
    (tmp_path / "t.yaml").write_text('targets:\n  - name: "N"\n    repo: "acme/app"\n    category: "iam"\n')
    targets = targets_from_yaml(spark, str(tmp_path / "t.yaml"))
    assert [tuple(r) for r in targets.collect()] == [("N", "acme/app", "iam", "")]
