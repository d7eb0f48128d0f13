"""Repeated strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

``repeated_starts`` takes a collection of byte strings and finds every place where a string of a given
length starts that also starts somewhere else.  Common prefixes of neighbouring suffixes are derived by
increasing value: intervals of suffixes with a common prefix are extended by one letter to the left,
level by level, and an interval that ends where no value is known yet gives the value there.  The
expansion stops at the length asked for; where no value is known by then, it is that length or more.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffixes in an order by at least their first ``length`` symbols, by prefix doubling.

    Also the ranks by a shorter beginning, and how long that is: where the expansion can start.
    """
    base = int(symbols.max()) + 2
    known = max(1, min(length, 62 // base.bit_length()))
    padded = np.concatenate((symbols + 1, np.zeros(known, np.int64)))
    key = np.zeros(len(symbols), np.int64)
    for i in range(known):
        key = key * base + padded[i : i + len(symbols)]
    begun, depth = None, known
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.concatenate(([False], ordered[1:] != ordered[:-1])))
        if begun is None or known <= length // 8:
            begun, depth = rank, known
        if known >= length or rank.max() == len(rank) - 1:
            return order, begun, depth
        behind = np.zeros(len(rank), np.int64)
        behind[:-known] = rank[known:] + 1
        key, known = rank * (len(rank) + 1) + behind, known * 2


def long_prefixes(symbols: np.ndarray, order: np.ndarray, begun: np.ndarray, depth: int, length: int) -> np.ndarray:
    """For each place in the order, whether its suffix shares ``length`` symbols or more with the one before."""
    n = len(symbols)
    before = symbols[order - 1]  # the transform; the first suffix is preceded by the last symbol
    # Where the suffix that begins one symbol to the left stands: equal symbols keep their order.
    step = np.empty(n, np.int64)
    step[np.argsort(before * n + np.arange(n))] = np.arange(n)
    first = symbols[order]
    # Common prefixes shorter than ``depth`` are known from the sort; all intervals of that depth are open.
    known = np.ones(n + 1, bool)
    known[1:n] = begun[order[1:]] != begun[order[:-1]]
    low = np.flatnonzero(known[:n])
    high = np.concatenate((low[1:], [n])) - 1
    for _ in range(depth, length):
        if not len(low):
            break
        size = high - low + 1
        owner = np.repeat(np.arange(len(low)), size)
        place = step[np.arange(len(owner)) + np.repeat(low - np.cumsum(size) + size, size)]
        if len(owner) > len(low):
            # Sorted by interval and place, the extensions by one symbol are runs of adjacent places.
            by = np.argsort(owner * n + place)
            place, owner = place[by], owner[by]
        new = np.ones(len(place), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1) | (first[place[1:]] != first[place[:-1]])
        starts = np.flatnonzero(new)
        lows, highs = place[starts], place[np.concatenate((starts[1:], [len(place)])) - 1]
        open_ = ~known[highs + 1]
        low, high = lows[open_], highs[open_]
        known[high + 1] = True
    return ~known[:n]


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, the places where ``length`` bytes start that also start elsewhere in the collection."""
    sizes = np.array([len(s) for s in strings], np.int64)
    if not sizes.sum():
        return [np.zeros(0, np.int64) for _ in strings]
    # A separator of its own after each string, so that nothing longer than a string is common.
    symbols = np.empty(int(sizes.sum()) + len(strings), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(strings), np.uint8)
    symbols[ends] = 256 + np.arange(len(strings))
    order, begun, depth = suffix_order(symbols, length)
    long = long_prefixes(symbols, order, begun, depth, length)
    marked = np.zeros(len(symbols), bool)
    marked[order[long]] = True
    marked[order[np.flatnonzero(long) - 1]] = True
    begins = ends - sizes
    return [np.flatnonzero(marked[b:e]) for b, e in zip(begins, ends, strict=True)]
