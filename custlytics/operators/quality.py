"""Data-quality reports, each one pass over the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from custlytics.functions import fixed_values as fixed


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column, as a number and a percentage of all rows."""
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in df.columns])

    def line(column: str):
        nulls = F.col("_rows") - F.col(column)
        return F.struct(
            F.lit(column).alias("column"),
            nulls.alias("nulls"),
            (F.try_divide(nulls, F.col("_rows")) * 100).alias("null_percentage"),
        )

    return counted.select(F.inline(F.array(*[line(c) for c in df.columns])))


def _violations(column: str, low, high) -> Column:
    tests = [F.col(column) < low] if low is not None else []
    tests += [F.col(column) > high] if high is not None else []
    return F.count_if(tests[0] if len(tests) == 1 else tests[0] | tests[1])


def checks(columns: Sequence[str], rules: Sequence[tuple] = fixed.VALID_RANGES) -> list[Column]:
    """The aggregates of :func:`null_profile` and :func:`range_checks` for taking them while a table is written:
    ``rows``, ``nulls_<column>`` and ``violations_<rule>``."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns]
    ranges = [_violations(column, low, high).alias(f"violations_{rule}") for rule, column, low, high in rules]
    return [F.count(F.lit(1)).alias("rows"), *nulls, *ranges]


def range_checks(df: DataFrame, rules: Sequence[tuple] = fixed.VALID_RANGES) -> DataFrame:
    """Number of values outside each rule's range; nulls pass."""
    lines = [
        F.struct(F.lit(rule).alias("rule"), _violations(column, low, high).alias("violations"))
        for rule, column, low, high in rules
    ]
    return df.agg(F.array(*lines).alias("_lines")).select(F.inline("_lines"))
