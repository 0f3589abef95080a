"""Text calculations, Column -> Column. Nulls give null unless said otherwise; positions start at 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def ascii_code(s: Column) -> Column:
    """Code of the first character."""
    return F.ascii(s)


def char(code: Column) -> Column:
    """The character of a code."""
    return F.char(code)


def contains(s: Column, part: Column | str, ignore_case: bool = False) -> Column:
    return F.contains(F.lower(s), F.lower(_col(part))) if ignore_case else F.contains(s, _col(part))


def startswith(s: Column, part: Column | str) -> Column:
    return F.startswith(s, _col(part))


def endswith(s: Column, part: Column | str) -> Column:
    return F.endswith(s, _col(part))


def find(s: Column, part: str, start: int = 1) -> Column:
    """Position of the first occurrence at or after `start`, 0 if there is none."""
    return F.locate(part, s, start)


def find_nth(s: Column, part: str, n: int) -> Column:
    """Position of the n-th occurrence, 0 if there are fewer."""
    there = F.size(F.split(s, F.lit(_quoted(part)))) > n
    return F.when(s.isNotNull(), F.when(there, F.length(F.substring_index(s, part, n)) + 1).otherwise(0))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def left(s: Column, n: int) -> Column:
    return F.left(s, F.lit(n))


def right(s: Column, n: int) -> Column:
    return F.right(s, F.lit(n))


def mid(s: Column, start: int, n: int | None = None) -> Column:
    """`n` characters from `start`, or all that follow."""
    return F.substring(s, F.lit(start), F.lit(n) if n is not None else F.length(s))


def length(s: Column) -> Column:
    return F.length(s)


def upper(s: Column) -> Column:
    return F.upper(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def proper(s: Column) -> Column:
    """Every word with a capital first letter."""
    return F.initcap(s)


def trim(s: Column) -> Column:
    return F.trim(s)


def ltrim(s: Column) -> Column:
    return F.ltrim(s)


def rtrim(s: Column) -> Column:
    return F.rtrim(s)


def replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def space(n: Column | int) -> Column:
    return F.repeat(F.lit(" "), _col(n))


def repeat(s: Column, n: Column | int) -> Column:
    return F.repeat(s, _col(n))


def reverse(s: Column) -> Column:
    return F.reverse(s)


def split(s: Column, delimiter: str, token: int = 1) -> Column:
    """The token-th part, counted from the end if negative; empty if there are fewer."""
    return F.split_part(s, F.lit(delimiter), F.lit(token))


def concat(*parts: Column) -> Column:
    return F.concat(*parts)


def regexp_match(s: Column, pattern: str) -> Column:
    return F.rlike(s, F.lit(pattern))


def regexp_extract(s: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match."""
    return F.nullif(F.regexp_extract(s, pattern, group), F.lit(""))


def regexp_replace(s: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(s, pattern, new)
