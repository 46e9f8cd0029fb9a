"""Rounding, shares and their texts, as exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(c: Column) -> Column:
    """Two decimals, half away from zero."""
    return F.round(c.cast("decimal(38,10)"), 2)


def average2(c: Column) -> Column:
    return round2(F.avg(c))


def percent_of(part: Column, total: Column) -> Column:
    """part * 100 / total with two decimals; null (no error) where total is 0 or null."""
    return F.round(F.try_divide(part.cast("decimal(20,0)") * F.lit(100), total.cast("decimal(20,0)")), 2)


def percent_where(condition: Column) -> Column:
    """Share of rows for which the condition holds; null conditions count as rows that do not."""
    return percent_of(F.sum(F.when(condition, 1).otherwise(0)), F.count(F.lit(1)))


def text2(c: Column, missing: str = "N/A") -> Column:
    return F.coalesce(c.cast("decimal(20,2)").cast("string"), F.lit(missing))


def percent_text(c: Column, missing: str = "N/A") -> Column:
    return F.coalesce(F.concat(c.cast("decimal(20,2)").cast("string"), F.lit("%")), F.lit(missing))


def signed(c: Column) -> Column:
    return F.when(c >= 0, F.concat(F.lit("+"), c.cast("string"))).otherwise(c.cast("string"))
