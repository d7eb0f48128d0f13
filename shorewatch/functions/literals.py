"""Literals that every match of a rule pattern contains.

A pack is only tried on texts that hold one of its literals.  ``required`` derives, from the pattern alone, a
set of texts of which each match contains one; ``presence`` tests a column for them: a few by substring search,
more by one expression shaped like a prefix tree, whose cost does not grow with the number of patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

from shorewatch.functions.dialect import _CLASS_ITEM, _TOKEN, to_java

#: Texts that are told apart for a part of a pattern, letters a useful literal has, and up to how many are searched one by one.
VARIANTS, SHORTEST, FEW = 16, 3, 12
#: Alternatives of one pattern.
MOST = 64


class Required(NamedTuple):
    """Every match contains one of ``literals``; ``folded``: they are in lower case and so must be what they are looked for in."""

    literals: tuple[str, ...]
    folded: bool


class _Part(NamedTuple):
    """``exact``: all texts that the part can match, if few; ``need``: one of them is in each match."""

    exact: frozenset[str] | None
    need: frozenset[str] | None = None


_NOTHING, _ANY = _Part(frozenset([""])), _Part(None)
# Control characters by escape letter.
_CONTROL = {"a": "\a", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def _useful(texts: frozenset[str] | None) -> bool:
    return bool(texts) and "" not in texts and len(texts) <= MOST


def _best(sets: Iterable[frozenset[str] | None]) -> frozenset[str] | None:
    """The set with the longest shortest text, fewer texts first."""
    return max((s for s in sets if _useful(s)), key=lambda s: (min(8, min(map(len, s))), -len(s)), default=None)


def _sequence(parts: list[_Part]) -> _Part:
    run, needs, whole = frozenset([""]), [], True
    for part in parts:
        if part.exact is not None and len(run) * len(part.exact) <= VARIANTS:
            run = frozenset(a + b for a in run for b in part.exact)
            continue
        whole = False
        needs += [run, part.need]
        run = part.exact or frozenset([""])
    return _Part(run if whole else None, _best([*needs, run]))


def _either(branches: list[_Part]) -> _Part:
    if len(branches) == 1:
        return branches[0]
    exact = frozenset().union(*(b.exact or () for b in branches)) if all(b.exact is not None for b in branches) else None
    needs = [_best([b.need, b.exact]) for b in branches]
    need = frozenset().union(*needs) if all(needs) else None
    return _Part(exact if exact is not None and len(exact) <= VARIANTS else None, need if _useful(need) else None)


def _repeated(part: _Part, low: int, high: int | None) -> _Part:
    if low == 0:
        return _Part(part.exact | {""}) if high == 1 and part.exact is not None else _ANY
    if low == high == 1:
        return part
    return _Part(None, _best([part.need, part.exact]))


class _Reader:
    def __init__(self, pattern: str):
        self.tokens, place = [], 0
        while place < len(pattern):
            token = _TOKEN.match(pattern, place)
            self.tokens.append(token)
            place = token.end()
        self.folded = any("i" in (t["flags"] or "").partition("-")[0] for t in self.tokens)
        self.next = 0

    def char(self, c: str) -> _Part:
        if not self.folded:
            return _Part(frozenset([c]))
        # Beyond ASCII, and for the two letters that have partners there, cases do not pair up one to one.
        return _Part(frozenset([c.lower()])) if c.isascii() and c not in "sSkK" else _ANY

    def text(self, chars: str) -> _Part:
        return _sequence([self.char(c) for c in chars])

    def escape(self, token: str) -> _Part:
        body = token[1:]
        if token in (r"\b", r"\B", r"\A", r"\z"):
            return _NOTHING
        if body[0] == "x":
            return self.char(chr(int(body[1:].strip("{}"), 16)))
        if body[0].isdigit():
            return self.char(chr(int(body, 8)))
        if body in _CONTROL:
            return self.char(_CONTROL[body])
        return _ANY if body[0].isalnum() else self.char(body)

    def bracket(self, token: str) -> _Part:
        items = list(_CLASS_ITEM.finditer(token[1:-1]))
        if token.startswith("[^") or not 0 < len(items) <= 4 or any(i["posix"] or i["char"] == "-" for i in items):
            return _ANY
        return _either([self.escape(i["escape"]) if i["escape"] else self.char(i["char"]) for i in items])

    def alternation(self) -> _Part:
        branches, parts = [], []
        while self.next < len(self.tokens):
            token = self.tokens[self.next]
            self.next += 1
            value = token.group()
            if token["close"]:
                break
            if token["repeat"]:
                if value[0] == "{":
                    low = int(token["low"])
                    high = low if token["high"] is None else int(token["high"]) if token["high"] else None
                else:
                    low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[value[0]]
                parts.append(_repeated(parts.pop(), low, high))
            elif token["quoted"]:
                # A repetition would be of the last letter alone.
                parts += [self.char(c) for c in token["literal"]]
            elif token["escape"]:
                parts.append(self.escape(value))
            elif token["cls"]:
                parts.append(self.bracket(value))
            elif token["group"]:
                parts.append(_NOTHING if token["flagend"] == ")" else self.alternation())
            elif value == "|":
                branches.append(_sequence(parts))
                parts = []
            else:
                parts.append(_NOTHING if value in "^$" else _ANY if value == "." else self.char(value))
        return _either([*branches, _sequence(parts)])


def required(pattern: str) -> Required | None:
    """Literals of which each match of the pattern in a line contains one; None where there are none of use."""
    to_java(pattern)
    reader = _Reader(pattern)
    part = reader.alternation()
    need = _best([part.need, part.exact])
    if need is None or min(map(len, need)) < SHORTEST or any("\n" in text for text in need):
        return None
    return Required(tuple(sorted(need)), reader.folded)


def smallest(literals: Iterable[str]) -> list[str]:
    """Without those that begin with another one."""
    kept: list[str] = []
    for text in sorted(literals):
        if not kept or not text.startswith(kept[-1]):
            kept.append(text)
    return kept


def prefix_tree(literals: Iterable[str]) -> str:
    """One expression that finds any of the literals, common beginnings written once."""
    tree: dict = {}
    for text in smallest(literals):
        node = tree
        for c in text:
            node = node.setdefault(c, {})

    def spell(node: dict) -> str:
        branches = [re.escape(c) + spell(below) for c, below in node.items()]
        return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})" if branches else ""

    return spell(tree)


def quoted(text: str) -> str:
    """As a string of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def presence(column: str, needs: Iterable[Required]) -> str:
    """SQL that is true where the column holds a literal of one of the needs."""
    tests, needs = [], list(needs)
    for folded in (False, True):
        subject = f"lower({column})" if folded else column
        found = smallest({text for need in needs if need.folded == folded for text in need.literals})
        if len(found) > FEW:
            tests.append(f"rlike({subject}, {quoted(prefix_tree(found))})")
        else:
            tests += [f"contains({subject}, {quoted(text)})" for text in found]
    return f"({' OR '.join(tests) or 'false'})"
