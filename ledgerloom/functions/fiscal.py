"""Fiscal years and dates as Column expressions. A fiscal year is named by the year it ends in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fy_end(fy: Column, month: int = 3, day: int = 31) -> Column:
    return F.make_date(fy, F.lit(month), F.lit(day))


def fy_of(date: Column, month: int = 3) -> Column:
    return F.when(F.month(date) > month, F.year(date) + 1).otherwise(F.year(date))


def reference_fy(date: Column, month: int = 3, day: int = 31) -> Column:
    """Latest fiscal year that ends strictly before the date."""
    fy = fy_of(date, month)
    return F.when(fy_end(fy, month, day) < date, fy).otherwise(fy - 1)


def parse_fy(label: Column) -> Column:
    """'2022-23', 'FY23' or '2023' to a year, the first form that matches; a two-digit end takes the first year's century."""
    s = F.upper(F.trim(label))
    span = r"(19|20)(\d{2})\s*[-/–]\s*(\d{2,4})"
    end = F.regexp_extract(s, span, 3)
    by_span = F.when(F.length(end) == 4, end).otherwise(F.concat(F.regexp_extract(s, span, 1), end))
    short = F.regexp_extract(s, r"FY\s*'?(\d{2,4})", 1)
    by_name = F.when(F.length(short) == 4, short.try_cast("int")).otherwise(short.try_cast("int") + 2000)
    return F.when(s.rlike(span), by_span.try_cast("int")).when(short != "", by_name).otherwise(F.regexp_extract(s, r"((?:19|20)\d{2})", 1).try_cast("int"))


def parse_date(text: Column) -> Column:
    """ISO first, else day first; what is neither is null."""
    s = F.trim(text)
    iso = F.try_to_date(F.regexp_extract(s, r"^(\d{4}-\d{1,2}-\d{1,2})", 1), "yyyy-M-d")
    day_first = F.try_to_date(F.regexp_replace(F.regexp_extract(s, r"^(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})", 1), "[/.]", "-"), "d-M-yyyy")
    return F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), iso).otherwise(day_first)


def months_between_days(days: Column) -> Column:
    """Months of 30.44 days, to one place, halves to even."""
    return F.bround(days / F.lit(30.44), 1)
