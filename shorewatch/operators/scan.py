"""The scan: files to findings.

Every step works inside the row of one file, so the job is a single narrow stage
however large the corpus is: no shuffle, no skew by repository, and the same code
runs on a stream.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shorewatch import model
from shorewatch import values as V
from shorewatch.functions import exemptions as ex
from shorewatch.functions import text
from shorewatch.functions.literals import prefix_tree, presence, quoted, smallest
from shorewatch.operators.exemptions import apply_config
from shorewatch.sources.rules import MAX_BROADCAST_BYTES, RulePack, table

#: Rules of a language up to which each is tried on each line, and literals of a rule up to which the line is searched first.
GROUP, GUARDS = 32, 4
_NO_RULES, _NO_KEYS, _NO_FLAGS = (f"CAST(array() AS array<{kind}>)" for kind in ("int", "string", "boolean"))

_EXT = model._fields(("ext", model.S), ("lang", model.S))
_ATTRIBUTES = model._fields(
    ("rule_ord", model.I),
    ("rule_id", model.S),
    *[(n, model.S) for n in ("algorithm", "severity", "message", "migration", "quantum_threat", "primitive")],
    ("composition", model.B),
)


def select_files(files: DataFrame, pack: RulePack) -> DataFrame:
    """Files in a known language outside skipped directories; adds ``lang``.

    Looks at the path only, so it runs before any content is read or split.
    """
    known = [{"ext": e, "lang": g} for e, g in sorted(pack.extension_map.items())]
    languages = table(files.sparkSession, known, _EXT)
    small = sum(len(json.dumps(r)) for r in known) <= MAX_BROADCAST_BYTES
    return (
        files.where(~text.in_skipped_directory(F.col("file")))
        .withColumn("ext", text.extension(F.col("file")))
        .join(F.broadcast(languages) if small else languages, "ext")
        .drop("ext")
    )


def _by_language(pack: RulePack) -> dict[str, list[dict]]:
    found: dict[str, list[dict]] = {}
    for row in pack.matchers:
        found.setdefault(row["lang"], []).append(row)
    return found


def _case(column: str, branches: dict[str, str], otherwise: str) -> str:
    whens = " ".join(f"WHEN {quoted(value)} THEN {branch}" for value, branch in branches.items())
    return f"CASE {column} {whens} ELSE {otherwise} END" if whens else otherwise


def _any_text(rows: list[dict]) -> str:
    """Whether a whole text may hold a match; true where a pattern has no form for whole texts."""
    if not all(r["text_rx"] for r in rows):
        return "true"
    return f"rlike(content, {quoted('|'.join(f'(?:{r["text_rx"]})' for r in rows))})"


def _worth_splitting(languages: dict[str, list[dict]]) -> Column:
    """Whether a text holds a literal that one of its language's patterns requires and, for a few patterns, one of them matches it.

    The literals of all patterns are one test, so what a file without any costs does not depend on the pack.
    """
    tests = {}
    for lang, rows in languages.items():
        free = [r for r in rows if r["need"] is None]
        held = presence("content", [r["need"] for r in rows if r["need"] is not None])
        tests[lang] = f"({held} OR {_any_text(free)})" if free else held
        if len(rows) <= GROUP:
            tests[lang] += f" AND {_any_text(rows)}"
    return F.col("lang").isin(*languages) & F.expr(_case("lang", tests, "false"))


def _rule_test(rule: dict) -> str:
    """The rule's number where it matches the line, else -1; the pattern, a literal compiled once a task, runs where its literals are."""
    test = f"rlike(text, {quoted(rule['line_rx'])})"
    if rule["need"] is not None and len(rule["need"].literals) <= GUARDS:
        test = f"{presence('text', [rule['need']])} AND {test}"
    return f"CASE WHEN {test} THEN {rule['ord']} ELSE -1 END"


def _unrolled(rows: list[dict]) -> list[dict]:
    """Rules that are tried one by one on each line: all of a small pack, of a large one those without literals."""
    kept = [r for r in rows if not r["recursive"]]
    return kept if len(kept) <= GROUP else [r for r in kept if r["need"] is None]


def _hits(languages: dict[str, list[dict]]) -> str:
    """Numbers of the rules that match the line, of those that are tried one by one."""
    found = {lang: f"array({', '.join(map(_rule_test, own))})" for lang, rows in languages.items() if (own := _unrolled(rows))}
    # The filter of nothing is not compiled and so keeps all of this out of the generated stage, whose one method would be too
    # large to be compiled by the virtual machine; the tests are, in small methods, as the arguments of a filter would not be.
    return f"concat(array_remove({_case('lang', found, _NO_RULES)}, -1), filter(if(pos < 0, array(pos), {_NO_RULES}), n -> false))"


def _may_match(languages: dict[str, list[dict]]) -> str:
    """Whether a line holds a literal that one of its language's patterns requires, or matches one that requires none."""
    tests = {}
    for lang, rows in languages.items():
        kept = [r for r in rows if not r["recursive"]]
        free = [r["line_rx"] for r in kept if r["need"] is None]
        held = presence("text", [r["need"] for r in kept if r["need"] is not None])
        tests[lang] = f"({held} OR rlike(text, {quoted('|'.join(f'(?:{rx})' for rx in free))}))" if free else held
    return _case("lang", tests, "false")


class _Index(NamedTuple):
    """Literals of the rules of large packs: what finds them in a line as it is and in lower case, and the rules of each."""

    plain: str
    folded: str
    rules: list[dict]


_KEYED = model._fields(
    ("k_lang", model.S), ("k_folded", model.B), ("k_key", model.S), ("k_ord", model.I), ("k_rx", model.S), ("k_all", model.T.ArrayType(model.S))
)


def _indexed(languages: dict[str, list[dict]]) -> _Index | None:
    found: dict[bool, dict[str, str]] = {False: {}, True: {}}
    rules = []
    for lang, rows in languages.items():
        kept = [r for r in rows if not r["recursive"]]
        own = [r for r in kept if r["need"] is not None] if len(kept) > GROUP else []
        for folded, subject in ((False, "text"), (True, "lower(text)")):
            these = [r for r in own if r["need"].folded == folded]
            if not these:
                continue
            least = smallest({x for r in these for x in r["need"].literals})
            # The look-ahead finds the literals of every place, overlapping ones too.
            found[folded][lang] = f"array_distinct(regexp_extract_all({subject}, {quoted(f'(?=({prefix_tree(least)}))')}, 1))"
            for r in these:
                keys = sorted({next(x for x in least if text.startswith(x)) for text in r["need"].literals})
                rules += [{"k_lang": lang, "k_folded": folded, "k_key": k, "k_ord": r["ord"], "k_rx": r["line_rx"], "k_all": keys} for k in keys]
    return _Index(*[_case("lang", found[f], _NO_KEYS) for f in (False, True)], rules) if rules else None


def _by_index(lines: DataFrame, hits: Column, index: _Index) -> DataFrame:
    """Adds ``rule_ord`` to lines: one row for each match.

    Literals of a line meet their rules in a join, and only those patterns are tried: what a line costs does not
    grow with the pack.  A rule of which a line holds several literals is tried with the first.
    """
    rules = table(lines.sparkSession, index.rules, _KEYED)
    small = sum(len(r["k_rx"]) + 64 for r in index.rules) <= MAX_BROADCAST_BYTES
    kind = "array<struct<ord: int, key: string, folded: boolean>>"
    tried = F.arrays_zip(hits, F.expr(_NO_KEYS), F.expr(_NO_FLAGS)).cast(kind)
    keyed = [
        F.expr(f"CAST(arrays_zip({_NO_RULES}, {column}, array_repeat({flag}, size({column}))) AS {kind})")
        for column, flag in (("plain", "false"), ("folded", "true"))
    ]
    met = lines.withColumns({"plain": F.expr(index.plain), "folded": F.expr(index.folded)})
    met = met.withColumn("candidate", F.explode(F.concat(tried, *keyed)))
    same = (F.col("lang") == F.col("k_lang")) & (F.col("candidate.folded") == F.col("k_folded")) & (F.col("candidate.key") == F.col("k_key"))
    met = met.join(F.broadcast(rules) if small else rules, same, "left")
    first = "k_key = array_min(array_intersect(k_all, if(k_folded, folded, plain)))"
    number = f"CASE WHEN candidate.ord IS NOT NULL THEN candidate.ord WHEN {first} AND rlike(text, k_rx) THEN k_ord END"
    met = met.withColumn("rule_ord", F.expr(number)).where("rule_ord IS NOT NULL")
    return met.drop("plain", "folded", "candidate", *[f.name for f in _KEYED.fields])


def _linear_hits(languages: dict[str, list[dict]]):
    """Matches of patterns on which the built-in engine recurses, by the linear engine of Arrow: numbers of rules by line."""
    patterns = {
        lang: [(r["ord"], r["pattern"]) for r in rows if r["recursive"]] for lang, rows in languages.items()
    }

    def match(langs, lines):
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        import pyarrow.compute as pc

        out = []
        for lang, file in zip(langs, lines):
            array = pa.array([] if file is None else list(file), pa.string())
            found = [None] * len(array)
            for number, pattern in patterns.get(lang, ()):
                for i in np.flatnonzero(pc.match_substring_regex(array, pattern).to_numpy(zero_copy_only=False)):
                    found[i] = [*(found[i] or ()), number]
            out.append(found)
        return pd.Series(out, dtype=object)

    # Annotated here, as the libraries are imported in the tasks.
    return F.pandas_udf(match, "array<array<int>>", F.PandasUDFType.SCALAR)


def match_rules(files: DataFrame, pack: RulePack) -> DataFrame:
    """One row per (file, rule, line) match, with the line's ``pos`` and ``text``, its ``snippet``, and in ``above``
    the non-blank line above it (null in files without annotations).

    Rules are tried together on the whole text; a file is split once.  Its lines are exploded, and those that hold
    no literal of a rule dropped, inside one generated stage, in which the array of lines is not copied; lines leave
    it with their surroundings only.  What is left is tested by the rules of its language, whose attributes are
    joined to the matches.
    """
    languages = _by_language(pack)
    if not languages:
        empty = files.limit(0).selectExpr("*", "0 pos", "'' text", "'' snippet", "'' above", "0 rule_ord")
        return _attributes(empty.drop("content"), pack)
    split = (
        files.where(_worth_splitting(languages))
        .withColumn("marked", F.contains("content", F.lit(V.MARKER)))
        .withColumn("lines", text.lines(F.col("content")))
        # Where no two blank lines stand together, the one above is the one before or that before it.
        .withColumn("before", F.when(F.col("marked") & text.has_blank_lines_together(F.col("content")), ex.text_line_above(F.col("lines"))))
        .drop("content")
    )
    may_match, hits = F.expr(_may_match(languages)), F.expr(_hits(languages))
    linear = any(r["recursive"] for rows in languages.values() for r in rows)
    if linear:
        split = split.withColumn("linear", _linear_hits(languages)("lang", "lines"))
        may_match |= F.get("linear", F.col("pos")).isNotNull()
        hits = F.concat(hits, F.coalesce("here", F.expr(_NO_RULES)))
    annotated = F.col("marked") & ~text.is_blank(F.col("text"))
    blank_before = text.is_blank(F.get("lines", F.col("pos") - 1))
    kept = (
        # The outer form only keeps the optimizer from splitting every file in an
        # inferred "has lines" filter; files without lines fall out in the match.
        split.select("*", F.posexplode_outer("lines").alias("pos", "text"))
        .where(may_match)
        .withColumns(
            {
                "snippet": text.snippet(F.col("lines"), F.col("pos") + 1),
                "above": F.when(annotated, F.get("lines", F.coalesce(F.get("before", F.col("pos")), F.col("pos") - F.when(blank_before, 2).otherwise(1)))),
            }
            | ({"here": F.get("linear", F.col("pos"))} if linear else {})
        )
        .drop("lines", "before", "marked", "linear")
    )
    if index := _indexed(languages):
        matched = _by_index(kept, hits, index)
    else:
        # A line that names its task is not merged with what is made of it: the tests run when the lines beside it are gone.
        alone = kept.withColumn("text", F.when(F.spark_partition_id() >= 0, F.col("text")))
        # Asked for outer rows, Spark adds no filter on the hits, which would find them twice.
        matched = alone.withColumn("hits", hits).withColumn("rule_ord", F.explode_outer("hits")).drop("hits").where("rule_ord IS NOT NULL")
    return _attributes(matched.drop("here"), pack)


def _attributes(matched: DataFrame, pack: RulePack) -> DataFrame:
    rows = [{**r, "rule_ord": r["ord"], "rule_id": r["id"]} for r in pack.rules]
    rules = table(matched.sparkSession, rows, _ATTRIBUTES)
    # The size of a pack is known; one beyond the limit is joined as Spark sees fit.
    small = sum(len(json.dumps(r)) for r in rows) <= MAX_BROADCAST_BYTES
    return matched.drop("lang").join(F.broadcast(rules) if small else rules, "rule_ord")


def raw_findings(files: DataFrame, pack: RulePack, as_of: Column) -> DataFrame:
    """Findings with inline annotations applied, before configured exemptions."""
    located = (
        match_rules(select_files(files, pack), pack)
        .withColumn("line", F.col("pos") + 1)
        .drop("pos", "text")
        .withColumn("note", ex.annotation(F.col("above")))
    )
    scope = F.col("note.rule")
    applies = (scope == "") | (scope == F.col("rule_id"))
    extra = [c for c in files.columns if c not in ("source", "file", "content")]
    return (
        located.withColumn("note", F.when(applies, F.col("note")))
        .withColumns(
            {
                "column": F.lit(0),
                "confidence": F.lit(V.CONFIDENCE),
                "exemption": F.when(
                    F.col("note").isNotNull(),
                    ex.exemption(F.col("note.reason"), F.lit(""), F.col("note.until"), "inline"),
                ),
                "status": F.when(F.col("note").isNull(), V.ACTIVE).otherwise(
                    ex.exempted_status(F.col("note.until"), as_of)
                ),
            }
        )
        .select(*model.FINDING_COLUMNS, *extra)
    )


def scan(
    files: DataFrame,
    pack: RulePack,
    as_of: Column | None = None,
    exemptions: DataFrame | None = None,
    collect_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Findings of a corpus ``files(source, file, content)``.

    ``exemptions`` are configured exemptions of all sources; see
    :func:`shorewatch.operators.exemptions.apply_config` for ``collect_bytes``.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    findings = raw_findings(files, pack, as_of)
    if exemptions is None:
        return findings
    return apply_config(findings, exemptions, as_of, collect_bytes)
