"""Many path globs at once.

The globs of a list are merged into a tree over path elements, which a path walks once, whatever the number of
globs.  Elements without wildcards are looked up; elements with wildcards are looked up by what stands before
their first and after their last wildcard, and only those are compared further.
"""

from __future__ import annotations

import re
from collections.abc import Iterable


class _Node:
    __slots__ = ("ends", "fixed", "wild", "lengths", "deep", "loops")

    def __init__(self, loops: bool = False):
        self.ends: list[int] = []
        self.fixed: dict[str, _Node] = {}
        self.wild: dict[tuple[str, str], dict[str, tuple[re.Pattern | None, _Node]]] = {}
        self.lengths: set[tuple[int, int]] = set()
        self.deep: _Node | None = None
        self.loops = loops

    def below(self, part: str) -> _Node:
        if part == "**":
            self.deep = self.deep or _Node(loops=True)
            return self.deep
        if "*" not in part and "?" not in part:
            return self.fixed.setdefault(part, _Node())
        ends = re.split(r"[*?]+", part)
        key = (ends[0], ends[-1])
        self.lengths.add((len(key[0]), len(key[1])))
        same = self.wild.setdefault(key, {})
        if part not in same:
            # One run of stars between two fixed ends says no more than the ends and the length do.
            plain = "?" not in part and len(ends) == 2
            body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in part)
            same[part] = (None if plain else re.compile(body, re.S), _Node())
        return same[part][1]


class GlobTree:
    """Globs with ``**`` for any number of elements, ``*`` and ``?`` inside one; an empty glob matches all paths."""

    def __init__(self, globs: Iterable[str]):
        self.top, self.always = _Node(), []
        for number, glob in enumerate(globs):
            if not glob:
                self.always.append(number)
                continue
            node = self.top
            for part in glob.split("/"):
                node = node.below(part)
            node.ends.append(number)

    def match(self, path: str) -> list[int]:
        """Numbers of the globs that match, ascending."""
        now = self._with_deep([self.top])
        for part in path.split("/"):
            after: list[_Node] = []
            for node in now:
                if node.loops:
                    after.append(node)
                if (child := node.fixed.get(part)) is not None:
                    after.append(child)
                for before, behind in node.lengths:
                    if before + behind <= len(part):
                        for rx, child in node.wild.get((part[:before], part[len(part) - behind :]), {}).values():
                            if rx is None or rx.fullmatch(part):
                                after.append(child)
            now = self._with_deep(after)
            if not now:
                break
        return sorted({*self.always, *(n for node in now for n in node.ends)})

    @staticmethod
    def _with_deep(nodes: list[_Node]) -> list[_Node]:
        """The nodes and those behind ``**`` elements, which may stand for no element."""
        found: dict[int, _Node] = {}
        for node in nodes:
            while node is not None and id(node) not in found:
                found[id(node)] = node
                node = node.deep
        return list(found.values())
