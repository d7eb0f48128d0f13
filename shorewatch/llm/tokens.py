"""Token ids of texts by a tokenizer file of the ``tokenizers`` library, remembered word by word."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from struct import pack

from tokenizers import Tokenizer
from tokenizers.models import Model

#: Words whose ids a task remembers at most.
REMEMBERED = 400_000
#: Characters that every Unicode version in use classes and lower-cases alike; texts with others go to the library.
SETTLED = [(0, 0x52F), (0x1E00, 0x1EFF), (0x2010, 0x2027), (0x2030, 0x205E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5)]


def characters(of: Callable[[str], bool]) -> str:
    """The settled characters that have a property, written as the inside of a class."""
    runs: list[list[int]] = []
    for low, high in SETTLED:
        for c in range(low, high + 1):
            if of(chr(c)):
                if runs and runs[-1][1] == c - 1:
                    runs[-1][1] = c
                else:
                    runs.append([c, c])
    return "".join(f"\\U{low:08x}-\\U{high:08x}" for low, high in runs)


def plain_pattern(pattern: str) -> re.Pattern:
    """A pattern whose classes name Unicode properties, with these written out for the faster engine.

    Good for settled texts only.  Unlike Python, the property of white space leaves out U+001C to U+001F.
    """
    properties = {
        r"\p{L}": lambda c: unicodedata.category(c)[0] == "L",
        r"\p{N}": lambda c: unicodedata.category(c)[0] == "N",
        r"\s": lambda c: c.isspace() and not "\x1c" <= c <= "\x1f",
    }
    for escape, of in properties.items():
        pattern = pattern.replace(escape, characters(of))
    return re.compile(pattern)


def as_bytes(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}I", *ids)


def byte_letters() -> dict[int, str]:
    """The letters that byte-level models write bytes with: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + n) for n, b in enumerate(others)}


class WordIds(dict):
    """Ids of lower-cased words, found by the model when a word is first met."""

    def __init__(self, model: Model, remembered: int):
        super().__init__()
        self.model, self.remembered, self.letters = model, remembered, byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.remembered:
            self.clear()
        written = word.encode().decode("latin-1").translate(self.letters)
        ids = as_bytes([token.id for token in self.model.tokenize(written)])
        self[word] = ids
        return ids


class Encoder:
    """Same ids as ``Tokenizer.encode(text, add_special_tokens=False)``, as little-endian unsigned 32-bit numbers.

    Where the tokenizer lower-cases, splits by one expression and codes each word by itself, a word is
    coded once and remembered.  Texts that name a special token or have unsettled characters, and
    tokenizers of another build, go through the library text by text.
    """

    def __init__(self, definition: str, remembered: int = REMEMBERED):
        self.tokenizer, self.split = Tokenizer.from_str(definition), None
        parts = json.loads(definition)
        self.special = [t["content"] for t in parts.get("added_tokens") or []]
        self.unsettled = re.compile(f"[^{characters(lambda c: True)}]")
        normal = [n.get("type") for n in (parts.get("normalizer") or {}).get("normalizers", [])]
        steps = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if (
            normal == ["NFC", "Replace", "Lowercase"]
            and parts["normalizer"]["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
            and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
            and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"])
            and parts["model"]["type"] == "BPE"
            and not re.search(r"\\p\{[^LN]|\\P|\\[dDwWS]", steps[0]["pattern"]["Regex"])
        ):
            self.split = plain_pattern(steps[0]["pattern"]["Regex"])
            self.ids = WordIds(self.tokenizer.model, remembered)

    def encode(self, text: str) -> bytes:
        if self.split is not None and not any(s in text for s in self.special):
            written = text if text.isascii() else unicodedata.normalize("NFC", text)
            # Python lower-cases a final sigma by its place in the word, the library letter by letter.
            written = "".join(map(str.lower, written)) if "Σ" in written else written.lower()
            if not self.unsettled.search(written):
                return b"".join(map(self.ids.__getitem__, self.split.findall(written)))
        return as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
