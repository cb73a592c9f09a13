"""Correlations, approximate quantiles, frequent items and moments."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import DataFrame, functions as F

from custlytics.functions import fixed_values as fixed


def corr_pairs(
    df: DataFrame, columns: Sequence[str], *, with_self: bool = True, stronger_than: float | None = None
) -> DataFrame:
    """Pearson correlation of each pair of columns, rows with a null left out pair by pair.

    All pairs are computed in one aggregate.
    """
    pairs = list((combinations_with_replacement if with_self else combinations)(columns, 2))
    lines = [
        F.struct(F.lit(a).alias("feature1"), F.lit(b).alias("feature2"), F.corr(a, b).alias("correlation"))
        for a, b in pairs
    ]
    table = df.agg(F.array(*lines).alias("_lines")).select(F.inline("_lines"))
    return table if stronger_than is None else table.filter(F.abs("correlation") > stronger_than)


def approx_quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], relative_error: float = 0.05
) -> DataFrame:
    """Quantiles whose rank is off by at most ``relative_error`` of the rows."""
    accuracy = max(1, round(1 / relative_error))
    found = df.agg(F.percentile_approx(column, [float(p) for p in probabilities], accuracy).alias("_q"))
    place = [F.struct(F.lit(float(p)).alias("probability"), F.col("_q")[i].alias("value")) for i, p in enumerate(probabilities)]
    return found.select(F.inline(F.array(*place)))


def frequent_items(df: DataFrame, column: str, support: float = fixed.FREQUENT_ITEM_SUPPORT) -> DataFrame:
    """Values that make up at least ``support`` of all rows, without false positives.

    A sketch with room for a few times 1 / ``support`` values finds all candidates; only these are counted.
    """
    sketch = df.select(F.col(column).alias("value")).freqItems(["value"], support / 2)
    candidates = sketch.select(F.explode("value_freqItems").alias("candidate"))
    found = df.select(F.col(column).alias("value")).join(
        F.broadcast(candidates),  # at most 2 / support rows
        F.col("value").eqNullSafe(F.col("candidate")),
        "left_semi",
    )
    counted = found.groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counted.filter(F.col("count") >= total * F.lit(support))


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance (sample), skewness and kurtosis (population), and how many values are null or NaN."""
    lines = [
        F.struct(
            F.lit(c).alias("column"),
            F.variance(c).alias("variance"),
            F.skewness(c).alias("skewness"),
            F.kurtosis(c).alias("kurtosis"),
            F.count_if(F.isnull(c)).alias("nulls"),
            F.count_if(F.isnan(F.col(c).cast("double"))).alias("nans"),
        )
        for c in columns
    ]
    return df.agg(F.array(*lines).alias("_lines")).select(F.inline("_lines"))
