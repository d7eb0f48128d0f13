"""License scans by ordered signature rules.

A text is reduced to its words.  Rules are regular expressions over the words, each behind a keyword
that a text must hold before the expression is tried.  Where detections overlap, those of better
priority stand and whatever lies inside them is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Phrases that are always reported, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Licence names as they are written, reduced to words; the versions in use; the identifier stem.
FAMILIES = [
    ("gnu general public license|gnu gpl|gpl", "1 2 3", "gpl"),
    ("gnu lesser general public license|gnu library general public license|gnu lgpl|lgpl", "2 2.1 3", "lgpl"),
    ("gnu affero general public license|affero general public license|gnu agpl|agpl", "1 3", "agpl"),
    ("gnu free documentation license|gfdl", "1.1 1.2 1.3", "gfdl"),
    ("apache license|apache software license", "1.0 1.1 2.0", "apache"),
    ("mozilla public license|mpl", "1.0 1.1 2.0", "mpl"),
    ("eclipse public license|epl", "1.0 2.0", "epl"),
    ("common development and distribution license|cddl", "1.0 1.1", "cddl"),
    ("common public license|cpl", "1.0", "cpl"),
    ("european union public licence|european union public license|eupl", "1.0 1.1 1.2", "eupl"),
    ("open software license|osl", "1.0 2.0 2.1 3.0", "osl"),
    ("academic free license|afl", "1.1 1.2 2.0 2.1 3.0", "afl"),
    ("artistic license", "1.0 2.0", "artistic"),
    ("boost software license|bsl", "1.0", "bsl"),
    ("sil open font license|ofl", "1.0 1.1", "ofl"),
    ("python software foundation license|psf license", "2.0", "psf"),
    ("zope public license|zpl", "1.1 2.0 2.1", "zpl"),
    ("cecill", "1.0 1.1 2.0 2.1", "cecill"),
    ("open data commons attribution license", "1.0", "odc-by"),
    ("open database license|odbl", "1.0", "odbl"),
    ("community data license agreement permissive", "1.0 2.0", "cdla-permissive"),
    ("community data license agreement sharing", "1.0", "cdla-sharing"),
    ("upstream compatibility license|ucl", "1.0", "ucl"),
    ("lucent public license", "1.0 1.02", "lpl"),
    ("latex project public license|lppl", "1.0 1.1 1.2 1.3", "lppl"),
    ("server side public license|sspl", "1.0", "sspl"),
    ("business source license|busl", "1.1", "busl"),
    ("microsoft public license|ms pl", "", "ms-pl"),
    ("microsoft reciprocal license|ms rl", "", "ms-rl"),
    ("do what the fuck you want to public license|wtfpl", "", "wtfpl"),
    ("university of illinois ncsa open source license", "", "ncsa"),
    ("mulan permissive software license", "1 2", "mulanpsl"),
]
CREATIVE_TERMS = ["by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"]
CREATIVE_NAMES = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s", "nc": "non ?commercial"}
CREATIVE_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
PLAIN_NAMES = [
    ("mit license|expat license|x11 license", "license", "mit"),
    ("isc license", " isc ", "isc"),
    ("zlib license|zlib libpng license", "zlib", "zlib"),
    ("the unlicense|unlicense org", "unlicense", "unlicense"),
    ("bsd zero clause license|0bsd", "bsd ", "0bsd"),
    ("(?:simplified|2 clause|two clause) bsd license|bsd (?:2 clause|simplified|freebsd)", "bsd", "bsd-2-clause"),
    ("(?:modified|new|revised|3 clause|three clause) bsd license|bsd (?:3 clause|new|revised)", "bsd", "bsd-3-clause"),
    ("(?:original|4 clause|four clause) bsd license|bsd (?:4 clause|original)", "bsd", "bsd-4-clause"),
    ("bsd license|bsd style license", "bsd", "bsd"),
    ("postgresql license", " postgresql ", "postgresql"),
    ("ruby license", " ruby ", "ruby"),
    ("php license", " php ", "php"),
    ("openssl license", " openssl ", "openssl"),
    ("curl license", " curl ", "curl"),
    ("public domain dedication|dedicated to the public domain|released into the public domain", "public domain", "public-domain"),
    ("cc0|cc zero|creative commons zero", " c", "cc0-1.0"),
]
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby granted", "isc"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution", "bsd"),
    ("neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse", "contributors", "bsd-3-clause"),
    ("all advertising materials mentioning features or use of this software must display", "advertising", "bsd-4-clause"),
    ("licensed under the apache license version 2 0", "apache", "apache-2.0"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla", "mpl-2.0"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable", "warranty", "zlib"),
    ("this is free and unencumbered software released into the public domain", "unencumbered", "unlicense"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "hereby granted", "bsl-1.0"),
    ("free software foundation either version 2 of the license or at your option any later version", "later version", "gpl-2.0-or-later"),
    ("free software foundation either version 3 of the license or at your option any later version", "later version", "gpl-3.0-or-later"),
    ("all rights reserved", "rights reserved", "proprietary"),
]
LINKS = [
    ("apache org licenses license 2 0", "apache org", "apache-2.0"),
    ("opensource org licenses mit(?: license(?: php)?)?", "opensource org", "mit"),
    ("opensource org licenses bsd(?: license(?: php)?)?", "opensource org", "bsd"),
    ("gnu org licenses gpl 2 0(?: html| txt)?", "gnu org", "gpl-2.0"),
    ("gnu org licenses gpl(?: 3 0)?(?: html| txt)?", "gnu org", "gpl-3.0"),
    ("gnu org licenses lgpl(?: 3 0)?(?: html| txt)?", "gnu org", "lgpl-3.0"),
    ("gnu org licenses agpl(?: 3 0)?(?: html| txt)?", "gnu org", "agpl-3.0"),
    ("mozilla org mpl 2 0", "mozilla org", "mpl-2.0"),
]


class Rule(NamedTuple):
    """A smaller priority comes first; relevance is what a detection adds to the score."""

    priority: int
    label: str
    keyword: str
    pattern: str
    relevance: float


def dotted(version: str) -> str:
    """Two numbers, as identifiers have them."""
    return version if "." in version else f"{version}.0"


def said(version: str) -> str:
    """Words that a version is written in; a final zero may be left out."""
    parts = version.split(".")
    return f"{parts[0]}(?: 0)?" if parts[1:] in ([], ["0"]) else " ".join(parts)


def build_rules() -> list[Rule]:
    """All rules in order: tags, notices, links, names with version and grant, names with version, names."""
    rules: list[Rule] = []
    lead, grant = "(?:version |v |ver |v)?", "(?: or (?:at your option )?(?:any )?later(?: version)?| or newer)"
    for names, versions, stem in FAMILIES:
        forms = "|".join(names.split("|"))
        for version in versions.split():
            label, words = f"{stem}-{dotted(version)}", said(version)
            for name in names.split("|"):
                gate = f" {name.split()[0]} "
                rules.append(Rule(40, f"{label}-or-later", gate, f"{name} {lead}{words}{grant}", 0.95))
                rules.append(Rule(41, f"{label}-only", gate, f"{name} {lead}{words} only", 0.95))
                rules.append(Rule(50, label, gate, f"{name} {lead}{words}", 0.9))
            rules.append(Rule(10, f"{label}-or-later", "spdx", f"spdx license identifier {stem.replace('-', ' ')} {words} or later", 1.0))
            rules.append(Rule(11, f"{label}-only", "spdx", f"spdx license identifier {stem.replace('-', ' ')} {words} only", 1.0))
            rules.append(Rule(12, label, "spdx", f"spdx license identifier {stem.replace('-', ' ')} {words}", 1.0))
        rules.append(Rule(60, stem, "licen", f"(?:{'|'.join(x for x in forms.split('|') if 'licen' in x) or forms + ' license'})", 0.7))
    for terms in CREATIVE_TERMS:
        label = "cc-" + terms.replace(" ", "-")
        name = " ".join(CREATIVE_NAMES[x] for x in terms.split())
        for version in CREATIVE_VERSIONS:
            words = said(version)
            rules.append(Rule(42, f"{label}-{version}", " cc ", f"cc {terms} {words}", 0.95))
            rules.append(Rule(42, f"{label}-{version}", "creative", f"creative commons {name}(?: international| unported)? (?:version )?{words}", 0.95))
            rules.append(Rule(30, f"{label}-{version}", "creative", f"creativecommons org licenses {terms} {words}", 1.0))
        rules.append(Rule(55, label, " cc ", f"cc {terms}", 0.7))
        rules.append(Rule(55, label, "creative", f"creative commons {name}", 0.8))
    for names, gate, label in PLAIN_NAMES:
        rules.append(Rule(60, label, gate, f"(?:{names})", 0.7))
        rules.append(Rule(13, label, "spdx", f"spdx license identifier {label.replace('-', ' ').replace('.', ' ')}", 1.0))
    rules += [Rule(20, label, gate, text, 1.0) for text, gate, label in NOTICES[:-1]]
    rules += [Rule(90, label, gate, text, 0.3) for text, gate, label in NOTICES[-1:]]
    rules += [Rule(30, label, gate, text, 1.0) for text, gate, label in LINKS]
    return sorted(rules, key=lambda r: (r.priority, -len(r.pattern), r.label, r.pattern))


RULES = build_rules()
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


class Detection(NamedTuple):
    """Words [start, end) and the rule that found them."""

    start: int
    end: int
    label: str
    priority: int
    relevance: float


def word_numbers(line: bytes, places: list[int]) -> list[int]:
    """Numbers of the words that follow the spaces at the given places."""
    if not places:
        return []
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    return np.searchsorted(spaces, places).tolist()


class Scanner:
    """Compiled rules of one worker."""

    def __init__(self, rules: list[Rule] = RULES, base: dict[str, str] = BASE):
        self.by_keyword: dict[bytes, list[tuple[Rule, re.Pattern]]] = {}
        for rule in rules:
            # A match starts and ends where words do; places are found even where matches overlap.
            compiled = re.compile(rf"(?<= )(?=({rule.pattern}) )".encode())
            self.by_keyword.setdefault(rule.keyword.encode(), []).append((rule, compiled))
        self.base = [(f" {phrase} ".encode(), label, len(phrase.split())) for phrase, label in base.items()]

    def detections(self, line: bytes) -> list[Detection]:
        """What the rules find in words that stand between single spaces, before any suppression."""
        found = []
        for keyword, rules in self.by_keyword.items():
            if keyword in line:
                for rule, pattern in rules:
                    found += [(m.start(1) - 1, m.group(1).count(b" ") + 1, rule) for m in pattern.finditer(line)]
        starts = word_numbers(line, [at for at, _, _ in found])
        return [
            Detection(start, start + words, rule.label, rule.priority, rule.relevance)
            for start, (_, words, rule) in zip(starts, found, strict=True)
        ]

    def places(self, line: bytes) -> list[Detection]:
        found = []
        for phrase, label, words in self.base:
            at = line.find(phrase)
            while at >= 0:
                found.append((at, words, label))
                at = line.find(phrase, at + 1)
        starts = word_numbers(line, [at for at, _, _ in found])
        return [Detection(n, n + words, label, 70, 0.6) for n, (_, words, label) in zip(starts, found, strict=True)]

    def scan(self, text: str | None) -> tuple[int, list[Detection], list[Detection]]:
        """Number of words, base places, and the detections that stand."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()
        line = b" " + b" ".join(words) + b" "
        return len(words), self.places(line), suppress(self.detections(line))


def suppress(found: list[Detection]) -> list[Detection]:
    """Detections that lie in no other of better priority or, at the same one, of greater length.

    Taken in order of priority, then length, then start and label; one that lies inside one already
    taken falls.  Of those taken, a staircase of growing starts and ends is enough to tell.
    """
    kept: list[Detection] = []
    starts: list[int] = []
    ends: list[int] = []
    for d in sorted(set(found), key=lambda d: (d.priority, d.start - d.end, d.start, d.label)):
        at = bisect_right(starts, d.start)
        if at and ends[at - 1] >= d.end:
            continue
        kept.append(d)
        last = at
        while last < len(ends) and ends[last] <= d.end:
            last += 1
        starts[at:last], ends[at:last] = [d.start], [d.end]
    return kept


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License detections of every whole text, one row per input row.

    Returns the id, n_words, n_base (places of base phrases), first_word and last_word (smallest and
    largest start of one, else null), base_labels and labels (distinct, sorted, comma-joined; the base
    ones are always among the latter), score (largest relevance of what was found) and detections
    (start, end, label: the intervals that stand).

    A null or empty text has no words, no labels and score 0.  Each row is scanned by itself, so ids may
    be null or repeat and other columns are ignored; an empty table gives an empty result.
    """
    scanner: list[Scanner] = []

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner[:] = scanner or [Scanner()]
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                n, base, more = scanner[0].scan(text if isinstance(text, str) else None)
                starts = [d.start for d in base]
                names = sorted({d.label for d in base})
                rows.append(
                    (
                        None if pd.isna(key) else key,
                        n,
                        len(base),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(names),
                        ",".join(sorted({*names, *(d.label for d in more)})),
                        max((d.relevance for d in [*base, *more]), default=0.0),
                        [{"start": d.start, "end": d.end, "label": d.label} for d in sorted(more)],
                    )
                )
            out = pd.DataFrame(
                rows,
                columns=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
            )
            for c in ("id", "first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            yield out

    slim = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    schema = (
        "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, detections array<struct<start: long, end: long, label: string>>"
    )
    return slim.mapInPandas(scan, schema).withColumnRenamed("id", id_col)
