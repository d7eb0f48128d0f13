"""Every match of a pattern contains a literal that is derived from it."""

import random
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from shorewatch.functions.literals import prefix_tree, presence, required

LETTERS = "abKs-É"


def pattern(pick, depth=0):
    def atom():
        kind = pick.randrange(12)
        if kind < 6:
            return "".join(pick.choice("abKsÉ") for _ in range(pick.randrange(1, 5)))
        if kind == 6 and depth < 2:
            return f"(?:{pattern(pick, depth + 1)})"
        if kind == 7 and depth < 2:
            return f"({pattern(pick, depth + 1)}|{pattern(pick, depth + 1)})"
        return pick.choice([r"[ab]", r"[^a]", r"\w", ".", r"\-", r"\x61", r"\b", "[a-b]", r"\Qab\E"])

    out = ""
    for _ in range(pick.randrange(1, 4)):
        part = atom()
        out += part + (pick.choice(["", "", "", "?", "*", "+", "{2}", "{0,1}", "{1,2}"]) if part != r"\b" else "")
    return out


@pytest.mark.parametrize("seed", range(4))
def test_matches_contain_a_literal(seed):
    pick, told, tried = random.Random(seed), 0, 0
    for _ in range(3000):
        p = pattern(pick)
        if pick.random() < 0.3:
            p = "(?i)" + p
        need = required(p)
        texts = ["".join(pick.choice(LETTERS + "Bk") for _ in range(pick.randrange(1, 14))) for _ in range(60)]
        matched = pc.match_substring_regex(pa.array(texts), p).to_pylist()
        if need is None:
            continue
        told += 1
        for text, hit in zip(texts, matched, strict=True):
            if hit:
                tried += 1
                text = text.lower() if need.folded else text
                assert any(x in text for x in need.literals), (p, text, need)
    assert told > 200 and tried > 30


@pytest.mark.parametrize(
    ("given", "literals"),
    [
        (r"\bMD5\b", ("MD5",)),
        (r"(?i)licen[cs]e", ("licen",)),
        (r"foo(bar|bazaar)+x?", ("foo",)),
        (r"one|tw", None),
        (r"a{3}b*|ccc+", None),
        (r"key\.(new|open)\(", ("key.new(", "key.open(")),
        (r"x*y?.[a-z]+", None),
        (r"\Qa.b\E\s+end", ("a.b", )),
        (r"two\nlines", None),
    ],
)
def test_literals(given, literals):
    need = required(given)
    assert (need and need.literals) == literals


def test_prefix_tree_finds_any(spark):
    pick = random.Random(1)
    words = ["".join(pick.choice("ab.*(é") for _ in range(pick.randrange(3, 7))) for _ in range(40)]
    texts = ["".join(pick.choice("ab.*(é") for _ in range(30)) for _ in range(400)]
    tree = re.compile(prefix_tree(words))
    want = [any(w in t for w in words) for t in texts]
    assert [bool(tree.search(t)) for t in texts] == want and len(set(want)) == 2
    needs = [required(re.escape(w)) for w in words]
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = frame.selectExpr("n", f"{presence('t', [n for n in needs if n])} AS found").orderBy("n").collect()
    assert [r.found for r in got] == want
