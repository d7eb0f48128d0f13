"""Annotation parsing, path globs, expiry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shorewatch import values as V
from shorewatch.functions.dialect import to_java
from shorewatch.functions.text import is_blank

_MARKER = to_java(V.MARKER_PATTERN).line
_RULE = to_java(V.ANNOTATION_RULE_PATTERN).line
_REASON = to_java(V.ANNOTATION_REASON_PATTERN).line
_UNTIL = to_java(V.ANNOTATION_UNTIL_PATTERN).line


def has_marker(line: Column) -> Column:
    """The substring test keeps the regular expression away from ordinary lines."""
    return F.contains(line, F.lit(V.MARKER)) & line.rlike(_MARKER)


def annotation_reason(line: Column) -> Column:
    """Double-quoted, single-quoted or bare text; only one of the groups takes part in a match."""
    return F.concat(*[F.regexp_extract(line, _REASON, g) for g in (1, 2, 3)])


def annotation(line: Column) -> Column:
    """``struct(rule, reason, until)`` of an annotation line; NULL for any other line and
    for a marker without a reason, which suppresses nothing."""
    rule, reason, until = (
        F.regexp_extract(line, _RULE, 1).alias("rule"),
        annotation_reason(line).alias("reason"),
        F.regexp_extract(line, _UNTIL, 1).alias("until"),
    )
    parsed = F.when(has_marker(line), F.struct(rule, reason, until))
    return F.when(~is_blank(parsed["reason"]), parsed)


def text_line_above(lines: Column) -> Column:
    """For each line the 0-based number of the last non-blank line above it, -1 where there is none.

    One pass over the file: each non-blank line is the answer for all lines up to the next one.  Take it before
    lines are exploded; a look-up by number then costs the same however long a run of blank lines is.
    """
    numbers = F.filter(F.transform(lines, lambda line, i: F.when(~is_blank(line), i)), lambda i: i.isNotNull())

    def spread(found: Column) -> Column:
        ends = F.concat(F.array(F.lit(-1)), found)
        limits = F.concat(found, F.array(F.size(lines) - 1))
        return F.flatten(F.zip_with(ends, limits, lambda own, limit: F.array_repeat(own, limit - F.greatest(own, F.lit(-1)))))

    # Of an array of one, so that the lines are looked at once for both uses.
    return F.get(F.transform(F.array(numbers), spread), F.lit(0))


def glob_regex(pattern: Column) -> Column:
    """Regular expression for ``'/' || path`` of a doublestar glob; empty matches all.

    ``**`` as a whole element spans any number of elements, ``*`` and ``?`` stay
    inside one element, everything else is literal.
    """

    def element(part: Column) -> Column:
        literal = F.regexp_replace(part, r"([^0-9A-Za-z_*?])", r"\\$1")
        wild = F.replace(F.replace(literal, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
        # Elements of any number are nothing or a slash and anything; the engine does not recurse on this form.
        return F.when(part == "**", F.lit("(?:/.*)?")).otherwise(F.concat(F.lit("/"), wild))

    body = F.array_join(F.transform(F.split(pattern, "/"), element), "")
    return F.when(F.coalesce(pattern, F.lit("")) == "", F.lit("")).otherwise(
        F.concat(F.lit(r"(?s)\A"), body, F.lit(r"\z"))
    )


def glob_matches(regex: Column, path: Column) -> Column:
    return F.rlike(F.concat(F.lit("/"), path), regex)


def is_expired(until: Column, as_of: Column) -> Column:
    """Past midnight UTC of the given day; an unreadable date never expires."""
    midnight = F.try_to_timestamp(F.concat(until, F.lit(" +00:00")), F.lit("yyyy-MM-dd XXX"))
    day = F.when(until != "", midnight)
    return F.coalesce(as_of > day, F.lit(False))


def exempted_status(until: Column, as_of: Column) -> Column:
    return F.when(is_expired(until, as_of), V.EXPIRED).otherwise(V.EXEMPTED)


def optional(text: Column) -> Column:
    """Empty text as NULL, the form in which absent report fields are dropped."""
    return F.when(text != "", text)


def exemption(reason: Column, owner: Column, until: Column, origin: str) -> Column:
    return F.struct(
        reason.alias("reason"),
        optional(owner).alias("owner"),
        optional(until).alias("until"),
        F.lit(origin).alias("source"),
    )
