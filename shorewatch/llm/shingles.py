"""Sets of hashed word shingles."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of a byte's place in its word and of a word's place in its shingle; fixed for all runs.
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all places, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words between spaces and U+0009 to U+000D, with A-Z in lower case, in order."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    if not _powers:
        _powers.append(np.cumprod(np.full(1 << 16, _PLACE, np.uint64)))
    powers = _powers[0]
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    start, end = edges[::2], edges[1::2]
    length = end - start
    # Letters of all words on end, each times a power of its place in its word.
    letters = raw[inside].astype(np.uint64)
    letters[(letters >= 65) & (letters <= 90)] += np.uint64(32)
    first = np.concatenate(([0], np.cumsum(length)))
    place = np.arange(len(letters)) - np.repeat(first[:-1], length)
    value = (letters + np.uint64(1)) * powers[place & 0xFFFF]
    if len(place) and place.max() > 0xFFFF:
        value *= mixed((place >> 16).astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
    return mixed(total[first[1:]] - total[first[:-1]] + length.astype(np.uint64))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; of all words where there are fewer; none without words."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    size = min(size, len(words))
    if size == 0:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    hashes = np.full(n, size, np.uint64)
    for i in range(size):
        hashes = mixed(hashes * _STEP + words[i : i + n])
    return np.unique(hashes)
