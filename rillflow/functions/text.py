"""Column functions for semi-structured text: built-in expressions only."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def escape_like(text: str) -> str:
    """Text that a LIKE pattern takes literally."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def equals_ci(c: str | Column, text: str) -> Column:
    return col(c).ilike(escape_like(text))


def starts_ci(c: str | Column, text: str) -> Column:
    return col(c).ilike(escape_like(text) + "%")


def contains_ci(c: str | Column, text: str) -> Column:
    return col(c).ilike("%" + escape_like(text) + "%")


def ilike_any(c: str | Column, patterns: Iterable[str]) -> Column:
    """Any of the patterns; null where the column is null; false for no patterns."""
    out = F.lit(False)
    for p in patterns:
        out = out | col(c).ilike(p)
    return out


def is_given(c: str | Column) -> Column:
    return col(c).isNotNull() & (col(c) != "")


def matches_ci(c: str | Column, pattern: str) -> Column:
    """The whole value matches, whatever its letter case (not before a last line feed either)."""
    return col(c).rlike(rf"(?i)\A(?:{pattern})\z")


def trailing_year(c: str | Column) -> Column:
    """The four digits at the end as int, else null."""
    return null_if_empty(F.regexp_extract(col(c), r"(\d{4})\z", 1)).try_cast("int")


def last_segment(c: str | Column, separator: str = ", ") -> Column:
    """What follows the last separator; the whole text where there is none."""
    return F.regexp_replace(col(c), rf"(?s)^.*{separator}", "")


def collapsed(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def added_date(c: str | Column) -> Column:
    """'Added on Sep 12, 2026' (prefix optional) as a date; null for what is no date."""
    text = collapsed(F.regexp_replace(col(c), r"^\s*Added on ", ""))
    return F.try_to_timestamp(text, F.lit("MMM d, yyyy")).cast("date")


def id_after(c: str | Column, path: str = "/result/") -> Column:
    """The integer after a path in a url; null where there is none or it does not fit."""
    return null_if_empty(F.regexp_extract(col(c), rf"{path}(\d+)", 1)).try_cast("int")


def first_number(c: str | Column, ranges: Iterable[tuple[float, float]]) -> Column:
    """The first number of a badge such as 'GPA 3.40', if it lies in one of the inclusive ranges."""
    n = null_if_empty(F.regexp_extract(col(c), r"[0-9.]+", 0)).try_cast("double")
    return F.when(in_ranges(n, ranges), n)


def in_ranges(c: Column, ranges: Iterable[tuple[float, float]]) -> Column:
    out = F.lit(False)
    for low, high in ranges:
        out = out | c.between(low, high)
    return out


def mapped(c: str | Column, known: Mapping[str, str], default: str | None = None) -> Column:
    """A dictionary's value after trim and lower case, else the default (else null)."""
    key, out = F.lower(F.trim(col(c))), F.lit(default)
    for k, v in known.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def title_case(c: str | Column) -> Column:
    """Every run of letters gets a capital and small letters."""
    runs = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")
