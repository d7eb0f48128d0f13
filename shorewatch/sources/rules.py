"""Rule packs: YAML reader, bundled pack, validation, layering.

A rule pack is small data by nature (tens to thousands of rules written by people),
so it is read and validated on the driver and becomes a Spark table whose size is
known exactly and broadcast only below ``MAX_BROADCAST_BYTES``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shorewatch import model
from shorewatch import values as V
from shorewatch.functions.dialect import PatternError, to_java
from shorewatch.functions.literals import required

FIELDS = [name for name, _ in model.RULE_FIELDS]
MAX_BROADCAST_BYTES = 8 << 20


class RuleError(ValueError):
    """A rule pack cannot be used."""


def problem_of(rule: dict) -> str | None:
    """Why the loader refuses this rule; None when it is fine."""
    try:
        to_java(rule["pattern"])
    except PatternError as error:
        return f"invalid pattern: {error}"
    for field, allowed in (("quantum_threat", V.THREATS), ("primitive", V.PRIMITIVES)):
        if not rule[field]:
            return f"{field} is required"
        if rule[field] not in allowed:
            return f"invalid {field} {rule[field]!r}"
    return None


def _clean(raw: dict) -> dict:
    rule = {name: "" if raw.get(name) is None else str(raw[name]) for name in FIELDS}
    rule["extensions"] = [str(e) for e in raw.get("extensions") or []]
    rule["composition"] = bool(raw.get("composition"))
    return rule


def _with_severity(rule: dict) -> dict:
    if rule["severity"]:
        return rule
    severe = rule["quantum_threat"] == "shor-broken" and rule["primitive"] in V.HARVESTABLE_PRIMITIVES
    return {**rule, "severity": "CRITICAL" if severe else V.THREAT_SEVERITY[rule["quantum_threat"]]}


def parse_rules(text: str, origin: str = "rules") -> list[dict]:
    """Rules of one YAML (or JSON, a YAML subset) document, not validated."""
    try:
        import yaml

        loaded = yaml.safe_load(text)
    except ImportError:
        loaded = json.loads(text)
    if loaded is None:
        return []
    if not isinstance(loaded, list) or not all(isinstance(r, dict) for r in loaded):
        raise RuleError(f"{origin}: expected a list of rules")
    return [_clean(rule) for rule in loaded]


#: What YAML refuses or reads in another way than JSON does: tabs between tokens, unusual line ends, escaped surrogates.
_NOT_AS_JSON = re.compile("[^\n\r -~\xa0-\u2027\u202a-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]" r"|\\u[dD][89A-Fa-f]")
_BETWEEN = re.compile(r"[ \n\r]*")


def _not_as_json(text: str):
    raise ValueError(f"JSON and YAML may differ: {text}")


def _json_rules(text: str) -> Iterator[dict]:
    """Rules of a JSON list that YAML reads alike, each decoded as it is asked for; ValueError for any other text."""
    if found := _NOT_AS_JSON.search(text):
        _not_as_json(ascii(found.group()))
    decoder = json.JSONDecoder(parse_float=_not_as_json, parse_constant=_not_as_json)
    place, close, comma = _BETWEEN.match(text).end(), False, "["
    while not close:
        if text[place : place + 1] != comma:
            _not_as_json(text[place : place + 1])
        place = _BETWEEN.match(text, place + 1).end()
        if comma == "[" and text[place : place + 1] == "]":
            break
        raw, place = decoder.raw_decode(text, place)
        if not isinstance(raw, dict):
            _not_as_json("no rule")
        yield _clean(raw)
        place, comma = _BETWEEN.match(text, place).end(), ","
        close = text[place : place + 1] == "]"
    if _BETWEEN.match(text, place + 1).end() != len(text):
        _not_as_json("more than a list")


def listed_rules(text: str, origin: str = "rules") -> Iterator[dict]:
    """The rules of :func:`parse_rules`, one after another where the document is JSON; a bad one is refused before the first."""
    try:
        for _ in _json_rules(text):
            pass
    except Exception:
        return iter(parse_rules(text, origin))
    return _json_rules(text)


def read_rule_directory(directory: str | Path) -> list[dict]:
    """All ``*.yaml``/``*.yml`` rules below a directory in walk order; a missing directory is empty."""
    root = Path(directory)
    found = sorted(
        (p for p in root.rglob("*") if p.is_file() and p.suffix in (".yaml", ".yml")),
        key=lambda p: p.relative_to(root).parts,
    )
    return [rule for path in found for rule in parse_rules(path.read_text("utf-8"), str(path))]


def bundled_rules() -> list[dict]:
    return parse_rules((Path(__file__).parent.parent / "rulepacks" / "bundled.yaml").read_text("utf-8"))


def table(spark: SparkSession, rows: list[dict], schema) -> DataFrame:
    """A local relation: no Python at run time, and the optimizer knows its size."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = {f.name: [row.get(f.name) for row in rows] for f in schema.fields}
    return spark.createDataFrame(pa.table(columns, schema=to_arrow_schema(schema)), schema=schema)


class RulePack:
    """Validated, merged rules in evaluation order."""

    def __init__(self, rules: Iterable[dict], mode: str = "FAILFAST"):
        kept, self.rejected = [], []
        for rule in rules:
            problem = problem_of(rule)
            if problem is None:
                kept.append(_with_severity(rule))
            else:
                self.rejected.append((rule["id"], problem))
        if self.rejected and mode == "FAILFAST":
            raise RuleError("; ".join(f"rule {i}: {p}" for i, p in self.rejected))
        # Last definition of an id wins and keeps the position of the first.
        self.rules = [{**r, "ord": n} for n, r in enumerate({r["id"]: r for r in kept}.values())]

    @classmethod
    def layered(cls, *layers: Iterable[dict], mode: str = "FAILFAST") -> RulePack:
        """Later layers override earlier ones."""
        return cls((rule for layer in layers for rule in layer), mode)

    @classmethod
    def load(cls, *directories: str | Path, use_bundled: bool = True, mode: str = "FAILFAST") -> RulePack:
        base = [bundled_rules()] if use_bundled else []
        return cls.layered(*base, *(read_rule_directory(d) for d in directories if d), mode=mode)

    @classmethod
    def from_table(cls, rules: DataFrame, mode: str = "FAILFAST") -> RulePack:
        """Rules kept in a table, ordered by ``ord``; a pack is validated on the driver, so the table passes through it."""
        rows = rules.select("ord", *FIELDS).collect()
        return cls((_clean(r.asDict()) for r in sorted(rows, key=lambda r: r["ord"])), mode)

    def __len__(self) -> int:
        return len(self.rules)

    def frame(self, spark: SparkSession) -> DataFrame:
        return table(spark, self.rules, model.RULES)

    @cached_property
    def extension_map(self) -> dict[str, str]:
        """File extension to language; rules add extensions but never redefine built-in ones."""
        declared = {
            ext.lower(): rule["language"]
            for rule in self.rules
            if rule["language"]
            for ext in rule["extensions"]
            if ext.startswith(".")
        }
        return {**declared, **V.EXTENSIONS}

    @cached_property
    def matchers(self) -> list[dict]:
        """One row per (rule, language); a rule without language applies to all of them."""
        languages = sorted(set(self.extension_map.values()))
        found = []
        for rule in self.rules:
            java = to_java(rule["pattern"])
            forms = {"line_rx": java.line, "text_rx": java.text, "recursive": java.recursive, "need": required(rule["pattern"])}
            found += [{**rule, "lang": language, **forms} for language in ([rule["language"]] if rule["language"] else languages)]
        return found
