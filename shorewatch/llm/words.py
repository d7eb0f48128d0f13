"""Words of texts as bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Letters, digits and everything beyond ASCII stay, A-Z in lower case; all other bytes separate words.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words(raw: bytes) -> list[bytes]:
    """Maximal runs of word bytes of a UTF-8 text."""
    return raw.translate(WORD_BYTES).split()


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(binary).to_pylist()]


def ragged(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... anew for each size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
