"""Merged globs against their elements compared one by one."""

import random

import pytest
from pyspark.sql import functions as F

from shorewatch import model
from shorewatch import values as V
from shorewatch.functions import exemptions as ex
from shorewatch.functions.globs import GlobTree
from shorewatch.operators.exemptions import apply_config
from shorewatch.sources.rules import table


def element(glob, part):
    """One element, letter by letter."""
    if not glob:
        return not part
    if glob[0] == "*":
        return element(glob[1:], part) or bool(part) and element(glob, part[1:])
    return bool(part) and glob[0] in ("?", part[0]) and element(glob[1:], part[1:])


def elements(globs, parts):
    if not globs:
        return not parts
    if globs[0] == "**":
        return any(elements(globs[1:], parts[i:]) for i in range(len(parts) + 1))
    return bool(parts) and element(globs[0], parts[0]) and elements(globs[1:], parts[1:])


def matches(glob, path):
    return not glob or elements(glob.split("/"), path.split("/"))


def some(pick, letters, most):
    return "/".join("".join(pick.choice(letters) for _ in range(pick.randrange(0, 4))) for _ in range(pick.randrange(1, most)))


@pytest.mark.parametrize("seed", range(3))
def test_tree_equals_elements_one_by_one(seed):
    pick = random.Random(seed)
    globs = [some(pick, "ab.*?[", 5).replace("***", "**") for _ in range(300)] + ["", "**", "**/**", "a/**/b", "**/a*b?", "a**", "*", "?*"]
    globs += ["/".join(pick.choice(["**", "a", "*", "b?", "a*a"]) for _ in range(pick.randrange(1, 6))) for _ in range(200)]
    tree = GlobTree(globs)
    hits = 0
    for _ in range(400):
        path = some(pick, "ab.[\n", 7)
        want = [n for n, g in enumerate(globs) if matches(g, path)]
        assert tree.match(path) == want
        hits += len(want)
    assert hits > 2000


def test_tree_equals_expression(spark):
    pick = random.Random(9)
    pairs = [(some(pick, "ab*?.", 4), some(pick, "ab.", 4)) for _ in range(500)]
    frame = table(spark, [{"n": i, "p": p, "f": f} for i, (p, f) in enumerate(pairs)], "n int, p string, f string")
    rx = ex.glob_regex(F.col("p"))
    got = frame.select("n", ((rx == "") | ex.glob_matches(rx, F.col("f"))).alias("hit")).orderBy("n").collect()
    assert [r.hit for r in got] == [bool(GlobTree([p]).match(f)) for p, f in pairs]


@pytest.mark.parametrize("collect_bytes", [8 << 20, 0])
def test_a_list_of_ten_thousand_entries(spark, collect_bytes):
    pick = random.Random(4)
    entries = [
        {
            "source": "big" if i % 10 else "small", "ord": i, "rule": pick.choice(["", "r1", "r2", "r3"]) if i % 50 == 0 else f"r{i % 5}",
            "path": f"d{i % 97}/" + pick.choice(["**", "*.go", f"f{i}*", "**/x/*", f"f{i}.go"]), "reason": "known", "owner": "", "until": "",
        }
        for i in range(10_000)
    ]
    entries += [{"source": "void", "ord": i, "rule": "", "path": "", "reason": r, "owner": "", "until": ""} for i, r in enumerate(["fine", "\t"])]
    rows = []
    for i in range(600):
        source = ("big", "big", "small", "void", "none")[i % 5]
        rows.append({"source": source, "file": f"d{pick.randrange(100)}/" + pick.choice([f"f{pick.randrange(9999)}.go", "x/y.go", "a/x/b"]), "rule_id": f"r{i % 6}", "line": i, "status": V.ACTIVE if i % 7 else V.EXPIRED})
    findings = table(spark, rows, model.FINDINGS)
    as_of = F.lit("2026-04-19 12:00:00+00:00").cast("timestamp")
    marked = [{**e, "reason": f"entry {e['ord']}" if e["reason"] == "known" else e["reason"]} for e in entries]
    found = apply_config(findings, table(spark, marked, model.CONFIG_EXEMPTIONS), as_of, collect_bytes, at_once=50)
    got = {r.line: (r.status, r.exemption and r.exemption.reason) for r in found.collect()}
    want = {}
    for r in rows:
        want[r["line"]] = (r["status"], None)
        if r["status"] == V.ACTIVE and r["source"] != "void":
            for e in marked:
                if e["source"] == r["source"] and e["rule"] in ("", r["rule_id"]) and matches(e["path"], r["file"]):
                    want[r["line"]] = (V.EXEMPTED, e["reason"])
                    break
    assert got == want and sum(w[1] is not None for w in want.values()) > 50
