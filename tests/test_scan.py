"""The scan against a plain Python reading of the rules on small fixtures."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from shorewatch import model
from shorewatch import values as V
from shorewatch.functions import exemptions as ex
from shorewatch.functions import text
from shorewatch.operators import exemptions as exops
from shorewatch.operators import scan as scan_module
from shorewatch.operators.scan import match_rules, raw_findings, scan, select_files
from shorewatch.sources.rules import RuleError, RulePack, _clean, bundled_rules, table

def now():
    return F.lit("2026-04-19 12:00:00+00:00").cast("timestamp")
M = V.MARKER


def files(spark, rows):
    return table(spark, [{"source": s, "file": f, "content": c} for s, f, c in rows], model.FILES)


def rule(rule_id, pattern, language="", **more):
    return _clean(
        {"id": rule_id, "pattern": pattern, "language": language, "quantum_threat": "shor-broken", "primitive": "signature", **more}
    )


def python_lines(content):
    parts = content.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def blank(line):
    return not line.strip("\t\n\x0b\x0c\r \x85\xa0       　")


CONTENTS = ["", "\n", "a", "a\n", "a\r\n", "a\n\r", "a\r\r\nb", "\r\n\r\n", "a\n\nb\n\n", "a\rb\nc\r", " x\ny\u0085z\n"]


def test_lines(spark):
    frame = table(spark, [{"i": i, "content": c} for i, c in enumerate(CONTENTS)], "i int, content string")
    got = frame.select("i", text.lines(F.col("content")).alias("l")).orderBy("i").collect()
    assert [r.l for r in got] == [python_lines(c) for c in CONTENTS]


def test_annotations_of_all_parts(spark):
    """Every combination of the parts that an annotation can have, in every order."""
    heads = [(f"// {M}", True), (f"<!-- {M}\t", True), (f"// {M}s", False), ("// note:", False)]
    rules = [("", ""), ("rule=tls-1.3_x", "tls-1.3_x"), ("rule=", "")]
    reasons = [('reason="a b, c"', "a b, c"), ("reason='d \"e\"'", 'd "e"'), ("reason=bare,", "bare,"), ('reason=""', ""), ("reason='\t '", "\t "), ("", "")]
    untils = [("", ""), ("until=2031-02-09", "2031-02-09"), ('until="2031-02-09"', ""), ("until=soon", "")]
    rows, want = [], []
    for (head, marked), r, why, end in itertools.product(heads, rules, reasons, untils):
        for order in itertools.permutations([r, why, end]):
            rows.append(" ".join([head, *(text for text, _ in order if text)]))
            kept = marked and not blank(why[1])
            want.append((r[1], why[1], end[1]) if kept else None)
    frame = table(spark, [{"i": i, "line": x} for i, x in enumerate(rows)], "i int, line string")
    got = [r.n and tuple(r.n) for r in frame.select("i", ex.annotation(F.col("line")).alias("n")).orderBy("i").collect()]
    assert [(row, g) for row, g in zip(rows, got, strict=True)] == list(zip(rows, want, strict=True))


def test_annotation_target_is_next_text_line(spark):
    content = f'module y\n\n# {M} reason="vault"\n\nsign(key)'
    got = exops.annotations(files(spark, [("s", "a.go", content)])).collect()
    assert [(r.target_line, r.reason) for r in got] == [(5, "vault")]


def statuses(spark, content, pack, exemptions=None):
    found = scan(files(spark, [("s", "a.go", content)]), pack, now(), exemptions)
    return {(r.rule_id, r.line): (r.status, r.exemption and r.exemption.source) for r in found.collect()}


def test_inline_statuses(spark):
    pack = RulePack([rule("matches", "hit"), rule("other", "hit")])
    note = f'// {M} rule=matches reason="x"'
    assert statuses(spark, f"{note}\n\n\t\nhit", pack) == {
        ("matches", 4): ("exempted", "inline"),
        ("other", 4): ("active", None),
    }
    one = RulePack([rule("r", "hit")])
    for until, expected in [
        ("2020-01-01", "expired-exemption"),
        ("2026-04-19", "expired-exemption"),
        ("2026-04-20", "exempted"),
        ('"2020-01-01"', "exempted"),
        ("2026-13-45", "exempted"),
    ]:
        assert statuses(spark, f"// {M} reason=x until={until}\nhit", one) == {("r", 2): (expected, "inline")}
    # Stacked annotations shield each other: only the last one targets the code line.
    stacked = f"// {M} reason=x\n// {M} rule=nobody reason=y\nhit"
    assert statuses(spark, stacked, one) == {("r", 3): ("active", None)}
    # An annotation line can be a finding itself, and the target of the one above.
    assert statuses(spark, f"// {M} reason=x\n// {M} reason=hit", one) == {("r", 2): ("exempted", "inline")}
    # Far away, over more blank lines than any one window.
    assert statuses(spark, f"// {M} reason=x\n" + "\n \t\n" * 1500 + "hit", one) == {("r", 3002): ("exempted", "inline")}


def test_config_exemptions(spark):
    pack = RulePack([rule("r", "hit"), rule("q", "hit")])
    entry = {"source": "s", "ord": 0, "rule": "r", "path": "", "reason": "why", "owner": "", "until": ""}

    def run(*entries, content="hit"):
        rows = [{**entry, **e, "ord": i} for i, e in enumerate(entries)]
        found = statuses(spark, content, pack, table(spark, rows, model.CONFIG_EXEMPTIONS))
        return {k[0]: v for k, v in found.items()}

    assert run({}) == {"r": ("exempted", "config"), "q": ("active", None)}
    assert run({"path": "*.java"}, {"rule": "", "until": "2020-01-01"}, {}) == {
        "r": ("expired-exemption", "config"),
        "q": ("expired-exemption", "config"),
    }
    assert run({}, {"reason": "\t "})["r"] == ("active", None)
    assert run({"source": "another"})["r"] == ("active", None)
    # An expired annotation is not rescued by a valid entry.
    content = f"// {M} rule=r reason=x until=2020-01-01\nhit"
    assert run({}, content=content)["r"] == ("expired-exemption", "inline")


def test_files_and_languages(spark):
    pack = RulePack(
        [
            rule("any", "hit"),
            rule("rb", "hit", "ruby", extensions=[".RB", "rake", ".py"]),
            rule("py", "hit", "python"),
        ]
    )
    paths = ["a.py", "a.rb", "x/a.RB", "a.rake", "build/a.py", "x/vendor/y/a.py", "build", "build.py", "x.out/a.py", "a", "a.txt"]
    found = raw_findings(files(spark, [("s", p, "hit") for p in paths]), pack, now())
    got = sorted((r.file, r.rule_id) for r in found.collect())
    expected = [(f, r) for f in ("a.py", "build.py", "x.out/a.py") for r in ("any", "py")]
    expected += [(f, r) for f in ("a.rb", "x/a.RB") for r in ("any", "rb")]
    assert got == sorted(expected)


def test_line_of_any_length_is_scanned(spark):
    pack = RulePack([rule("r", "hit")])
    long = "é" * 700_000
    rows = [("s", "long.go", f"hit\n{long}\nhit"), ("s", "in.go", f"{long}hit{long}")]
    got = raw_findings(files(spark, rows), pack, now()).select("file", "line").collect()
    assert sorted(map(tuple, got)) == [("in.go", 1), ("long.go", 1), ("long.go", 3)]


def test_patterns_that_recurse_on_long_lines(spark):
    """Repeated groups go to the linear engine; the built-in one would exhaust its stack on such a line."""
    pack = RulePack([rule("alternatives", r"(?:ab|cd)*x"), rule("words", r"(\w+\s?)+\("), rule("plain", "tail")])
    assert [m["recursive"] for m in pack.matchers if m["lang"] == "go"] == [True, True, False]
    line = "abcd" * 250_000
    rows = [("s", "a.go", f"{line}\n{line}x\nfoo bar(\n\ntail(")]
    got = raw_findings(files(spark, rows), pack, now()).select("rule_id", "line").collect()
    assert sorted(map(tuple, got)) == [("alternatives", 2), ("plain", 5), ("words", 3), ("words", 5)]


def corpus(seed, count):
    pick = random.Random(seed)
    words = ["hit", "hat", "", "\t", " ", "x hit y", "\x0b", f"// {M} reason=a", f"# {M} rule=two reason='b' until=2020-01-01",
             f"{M} rule=one", "hat hit", "　", "ok\rhit"]
    rows = []
    for i in range(count):
        body = pick.choice(["\n", "\r\n"]).join(pick.choice(words) for _ in range(pick.randint(0, 14)))
        rows.append((f"s{i % 3}", f"d{i % 5}/f{i}{pick.choice(['.go', '.py', '.txt'])}", body + pick.choice(["", "\n"])))
    return rows


PACK = RulePack([rule("one", "hit$", "go"), rule("two", r"\bhit"), rule("empty", "^$"), rule("three", "h[ai]t", "python")])


def brute_force(rows):
    import re

    out = set()
    regexes = {"one": ("go", r"hit\Z"), "two": ("", r"(?<![0-9A-Za-z_])hit"), "empty": ("", r"\A\Z"), "three": ("python", "h[ai]t")}
    for source, file, content in rows:
        lang = {"go": "go", "py": "python"}.get(file.rsplit(".", 1)[1])
        if lang is None:
            continue
        lines = python_lines(content)
        notes = {}
        for i, line in enumerate(lines):
            if not re.search(M + r"(?![0-9A-Za-z_])", line):
                continue
            reason = re.search(r"\breason=(?:\"([^\"]*)\"|'([^']*)'|([^ \t\n\f\r]+))", line)
            target = next((j for j in range(i + 1, len(lines)) if not blank(lines[j])), None)
            if reason and target is not None:
                scope, until = re.search(r"\brule=([\w.:/-]+)", line), re.search(r"until=([\d-]{10})", line)
                notes[target] = (scope and scope[1], until and until[1])
        for rule_id, (language, regex) in regexes.items():
            for i, line in enumerate(lines):
                if language in ("", lang) and re.search(regex, line):
                    status = "active"
                    if i in notes and notes[i][0] in (None, rule_id):
                        past = notes[i][1] and dt.date.fromisoformat(notes[i][1]) <= dt.date(2026, 4, 19)
                        status = "expired-exemption" if past else "exempted"
                    start = max(i - 2, 0)
                    out.add((source, file, rule_id, i + 1, "\n".join(lines[start : start + 5]), status))
    return out


def collected(findings):
    return {
        (r.source, r.file, r.rule_id, r.line, r.snippet, r.status)
        for r in findings.select("source", "file", "rule_id", "line", "snippet", "status").collect()
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_equals_brute_force(spark, seed):
    rows = corpus(seed, 400)
    assert collected(raw_findings(files(spark, rows), PACK, now())) == brute_force(rows)


def test_every_matching_strategy_gives_the_same(spark, monkeypatch):
    frame = files(spark, corpus(3, 200))
    expected = collected(raw_findings(frame, PACK, now()))
    assert collected(raw_findings(frame.repartition(7), PACK, now())) == expected
    # All patterns on the linear engine, then rule attributes without broadcast.
    everything = [{**m, "recursive": True, "text_rx": ""} for m in PACK.matchers]
    monkeypatch.setattr(RulePack, "matchers", everything)
    assert collected(raw_findings(frame, PACK, now())) == expected
    monkeypatch.undo()
    monkeypatch.setattr(scan_module, "MAX_BROADCAST_BYTES", 0)
    assert collected(raw_findings(frame, PACK, now())) == expected


def test_narrow_plan(spark):
    """No shuffle, no Python, line arrays never leave the generated stage of the match."""
    frame = files(spark, corpus(4, 20))
    plan = raw_findings(frame, PACK, now())._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan
    assert plan.replace("BroadcastExchange", "").count("Exchange") == 0
    selected = match_rules(select_files(frame, PACK), PACK)
    assert "Sort" not in selected._jdf.queryExecution().executedPlan().toString()


def test_bundled_pack():
    pack = RulePack(bundled_rules())
    assert len(pack) == 27
    severities = {r["id"]: r["severity"] for r in pack.rules}
    assert [severities[i] for i in ("go-rsa-generate", "go-ecdsa", "go-tls-rsa-cipher", "java-sha1-sig")] == [
        "CRITICAL", "HIGH", "MEDIUM", "CRITICAL",
    ]
    assert not pack.rejected


def test_layers_and_rejections(tmp_path):
    base = [rule("a", "1"), rule("b", "2")]
    merged = RulePack.layered(base, [rule("c", "3"), rule("a", "4")], [rule("c", "5")])
    assert [(r["id"], r["pattern"], r["ord"]) for r in merged.rules] == [("a", "4", 0), ("b", "2", 1), ("c", "5", 2)]
    bad = [rule("x", "("), rule("y", "y", quantum_threat=""), rule("z", "z", primitive="cipher")]
    with pytest.raises(RuleError):
        RulePack(bad)
    lenient = RulePack([*base, *bad], mode="DROPMALFORMED")
    assert len(lenient) == 2 and [i for i, _ in lenient.rejected] == ["x", "y", "z"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "r.yml").write_text("- {id: two, pattern: x, quantum_threat: unknown, primitive: mac}\n")
    (tmp_path / "b.yaml").write_text("- {id: one, pattern: x, quantum_threat: pqc-broken, primitive: mac}\n")
    (tmp_path / "c.YAML").write_text("not read")
    loaded = RulePack.load(tmp_path, tmp_path / "missing", use_bundled=False)
    assert [(r["id"], r["severity"]) for r in loaded.rules] == [("two", "MEDIUM"), ("one", "CRITICAL")]


def test_annotations_before_long_blank_runs(spark):
    """1,000 annotations, each before 1,000 blank lines; a search that looked at all lines for each would take minutes."""
    blanks, notes = "\n \t" * 1000, 1000
    content = "hit\n" + "\n".join(f'// {M} reason="n{i}"{blanks}\nhit {i}\n\nhit' for i in range(notes))
    pack = RulePack([rule("matches", "hit")])
    begun = dt.datetime.now()
    frame = files(spark, [("s", "a.go", content)])
    found = {r.line: r.exemption and r.exemption.reason for r in scan(frame, pack, now()).collect()}
    targets = {r.target_line: r.reason for r in exops.annotations(frame).collect()}
    assert (dt.datetime.now() - begun).total_seconds() < 60
    want = {2 + 1004 * i + 1001: f"n{i}" for i in range(notes)}
    assert targets == want
    assert {line: reason for line, reason in found.items() if reason} == want
    assert len(found) == 2 * notes + 1
