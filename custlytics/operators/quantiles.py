"""Exact quantiles.

Spark's exact percentile keeps every distinct value of a group in one task's memory. Up to
``max_group_rows`` rows per group that is the cheapest way and is used as it is. Beyond, the column is
first reduced to a table of (value, count), whose running counts (computed in bounded blocks) show which
values hold the wanted positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from custlytics.operators.ordered import group_rows, large_groups, ordered_columns
from custlytics.session import checkpointed


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    *,
    discrete: bool = False,
    max_group_rows: int | None = None,
) -> DataFrame:
    """One row per group with an array of quantiles (in the order asked) for each column; nulls are skipped.

    A group without any value has null quantiles. Quantiles interpolate linearly between neighbours, or with ``discrete`` are the smallest values
    whose share of rows reaches the probability.
    """
    max_group_rows = group_rows(max_group_rows)
    if not large_groups(df, by, max_group_rows).isEmpty():
        return _by_counting(df, columns, probabilities, by, discrete, max_group_rows)
    if discrete:
        arrays = [
            F.array(*[F.expr(f"percentile_disc({p}) within group (order by `{c}`)") for p in probabilities]).alias(c)
            for c in columns
        ]
    else:
        wanted = F.array(*[F.lit(float(p)) for p in probabilities])
        arrays = [F.percentile(c, wanted).alias(c) for c in columns]
    return df.groupBy(*by).agg(*arrays)


def _by_counting(df, columns, probabilities, by, discrete, max_group_rows) -> DataFrame:
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns])
    )
    counted = (
        df.select(*by, pairs.alias("_pair"))
        .select(*by, "_pair.*")
        .groupBy(*by, "_column", "_value")
        # A null value counts no rows but keeps its group.
        .agg(F.count("_value").alias("_count"))
    )
    counted = checkpointed(counted)
    reached = ordered_columns(
        counted,
        [*by, "_column"],
        ["_value"],
        running={"_reached": ("sum", "_count")},
        max_group_rows=max_group_rows,
    )
    totals = counted.groupBy(*by, "_column").agg(F.sum("_count").alias("_total"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*by, "_column"]]
    joined = reached.alias("r").join(totals.alias("t"), same).select("r.*", "t._total")

    def value_at(place: Column) -> Column:
        return F.min(F.when(F.col("_reached") >= place, F.col("_value")))

    found = []
    for p in probabilities:
        if discrete:
            found.append(value_at(F.greatest(F.ceil(F.col("_total") * p), F.lit(1))))
            continue
        place = (F.col("_total") - 1) * F.lit(float(p))
        low, high = value_at(F.floor(place) + 1), value_at(F.ceil(place) + 1)
        share = F.max(place - F.floor(place))
        found.append(low + (high - low) * share)
    valued = F.when(F.max("_total") > 0, F.array(*found))
    tall = joined.groupBy(*by, "_column").agg(valued.alias("_quantiles"))
    return tall.groupBy(*by).agg(
        *[F.first(F.when(F.col("_column") == c, F.col("_quantiles")), ignorenulls=True).alias(c) for c in columns]
    )


def named(probability: float) -> str:
    """Column suffix of a probability: 0.25 gives ``p25``."""
    text = f"{probability * 100:g}".replace(".", "_")
    return f"p{text}"


def as_struct(quantile_row: DataFrame) -> Column:
    """The single row of ungrouped quantiles as a scalar subquery: a struct of arrays."""
    return quantile_row.select(F.struct("*")).scalar()


