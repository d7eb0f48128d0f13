"""Lines, snippets and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shorewatch import values as V

# The first branch is the common case, the second one complete.
_NOT_SPACE = rf"[\x21-\x7E]|[^{V.SPACE_CLASS}]"
_SPACES = f"[{V.SPACE_CLASS}]+"


def decode(content: Column) -> Column:
    """Bytes or text as a valid string; bad byte sequences become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def lines(content: Column) -> Column:
    """Lines ending at ``\\n``; one ``\\r`` before the end belongs to the terminator,
    and nothing follows the last terminator."""
    # Without its last terminator a text is split once; the generated code of the scan stays small enough to be compiled.
    body = F.when(F.endswith(content, F.lit("\n")), F.left(content, F.char_length(content) - 1)).otherwise(content)
    unix = F.when(F.contains(content, F.lit("\r")), F.regexp_replace(body, "\\r(?=\\n|\\z)", "")).otherwise(body)
    return F.when(content == "", F.slice(F.array(F.lit("")), 1, 0)).otherwise(F.split(unix, "\n"))


def is_blank(line: Column) -> Column:
    return ~line.rlike(_NOT_SPACE)


def has_blank_line(content: Column) -> Column:
    """Some line that has another one, or the text's last terminator, behind it is blank."""
    return content.rlike(rf"(?:\A|\n)[{V.SPACE_CLASS}&&[^\n]]*+\n")


def has_blank_lines_together(content: Column) -> Column:
    """As :func:`has_blank_line` where the line before is blank too, or there is none; true for some other texts as well."""
    blank = rf"[{V.SPACE_CLASS}&&[^\n]]*+\n"
    return content.rlike(rf"(?:\A|\n{blank}){blank}")


def snippet(all_lines: Column, line_no: Column) -> Column:
    """Five lines starting two above the match, clamped at the start of the file."""
    return F.array_join(F.slice(all_lines, F.greatest(line_no - 2, F.lit(1)), 5), "\n")


def squeeze(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACES, " "))


def extension(file: Column) -> Column:
    return F.lower(F.regexp_extract(file, r"(\.[^./]*)\z", 1))


def in_skipped_directory(file: Column) -> Column:
    """Some directory of the repository-relative path has a skipped name."""
    names = "|".join(name.replace(".", r"\.") for name in V.SKIPPED_DIRECTORIES)
    return file.rlike(rf"(?:\A|/)(?:{names})/")


def segments(file: Column) -> Column:
    """Path elements; ordering by this array is the order of a directory walk."""
    return F.split(file, "/")


def short_path(file: Column) -> Column:
    """The last three path elements."""
    return F.regexp_extract(file, r"([^/]*(?:/[^/]*){0,2})\z", 1)


def base_name(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]*)\z", 1)


def slug(repo: Column) -> Column:
    return F.replace(repo, F.lit("/"), F.lit("-"))
