"""Date helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def iso_weekday(day: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(day) + 1


def is_weekend(day: Column) -> Column:
    return F.when(F.weekday(day) >= 5, 1).otherwise(0)


def weekday_name(day: Column) -> Column:
    return F.date_format(day, "E")


def month_label(day: Column) -> Column:
    """Month as ``yyyy-MM``."""
    return F.date_format(day, "yyyy-MM")


def days_since(day: Column, as_of: Column | None = None) -> Column:
    return F.datediff(F.current_date() if as_of is None else as_of, day)
