"""Column functions on text whose results equal Python's string semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that Python's strip() removes, as a Java class.
WS = r"[\s\x1C-\x1F\x85\p{Z}]"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"
FILE_MENTION = r"(?U)[\w./\\-]+\.\w{1,5}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def is_blank(c: Column) -> Column:
    return F.length(strip(F.coalesce(c, F.lit("")))) == 0


def split_lines(c: Column) -> Column:
    """Lines of a text; no empty line after a last break, none of an empty text."""
    parts = F.split(F.coalesce(c, F.lit("")), LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, f"^{WS}+", ""))


def first_line(c: Column, n: int) -> Column:
    """The first n characters of the first line of the stripped text; empty without one."""
    return F.substring(F.coalesce(F.get(split_lines(strip(F.coalesce(c, F.lit("")))), F.lit(0)), F.lit("")), 1, n)


def token_count(c: Column) -> Column:
    """Estimated tokens: a fourth of the code points, rounded up, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("long")


def content_hash(c: Column) -> Column:
    """sha-256 of a text after its line ends are made one kind."""
    return F.sha2(F.regexp_replace(c, "\r\n?", "\n").cast("binary"), 256)


def file_mentions(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(FILE_MENTION), F.lit(0))


def slice_lines(c: Column, start: Column, end: Column) -> Column:
    """Lines start to end, counted from 1, joined again."""
    return F.array_join(F.slice(split_lines(c), start, F.greatest(F.lit(0), end - start + 1)), "\n")
