"""De-duplication, imputation, outlier capping and derived customer columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from custlytics.functions import fixed_values as fixed, labels
from custlytics.functions.dates import days_since
from custlytics.operators.quantiles import as_struct, quantiles


def numeric_columns(df: DataFrame, *, excluding: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in excluding]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def deduplicate(df: DataFrame, keys: Sequence[str], first_by: Sequence[Column] = ()) -> DataFrame:
    """One row per key: the one that sorts first by ``first_by``, then by all other columns.

    Every task cuts its copies of a key to one before the shuffle, so a key with very many copies costs
    no more than any other.
    """
    others = [F.col(c).asc_nulls_first() for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    copies = Window.partitionBy(*keys).orderBy(*first_by, *others)
    return df.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") == 1).drop("_copy")


def clean_customers(
    df: DataFrame,
    *,
    key: str = "customer_id",
    first_by: Sequence[Column] = (),
    validator: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per customer, without missing keys or e-mail addresses, with ``age_group``."""
    known = deduplicate(df.filter(F.col(key).isNotNull()), [key], first_by).filter(F.col("email").isNotNull())
    grouped = known.withColumn("age_group", labels.age_group(F.col("age")))
    return grouped.transform(validator) if validator else grouped


def impute(df: DataFrame, columns: Sequence[str], strategy: str = "mean") -> DataFrame:
    """Fill nulls with the column's mean or median; the columns become doubles."""
    if strategy == "mean":
        fill = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns])).scalar()
        value = {c: fill[c] for c in columns}
    elif strategy == "median":
        fill = as_struct(quantiles(df, columns, [0.5]))
        value = {c: fill[c][0] for c in columns}
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), value[c]) for c in columns})


def outlier_bounds(df: DataFrame, columns: Sequence[str], factor: float = fixed.IQR_FACTOR) -> DataFrame:
    """One row with a struct (low, high) per column: quartiles widened by ``factor`` interquartile ranges."""
    quartiles = quantiles(df, columns, [0.25, 0.75])

    def bounds(column: str) -> Column:
        low, high = F.col(column)[0], F.col(column)[1]
        reach = (high - low) * factor
        return F.struct((low - reach).alias("low"), (high + reach).alias("high")).alias(column)

    return quartiles.select(*[bounds(c) for c in columns])


def cap_outliers(df: DataFrame, columns: Sequence[str], factor: float = fixed.IQR_FACTOR) -> DataFrame:
    limits = as_struct(outlier_bounds(df, columns, factor))
    return df.withColumns(
        {c: labels.clip(F.col(c).cast("double"), limits[c]["low"], limits[c]["high"]) for c in columns}
    )


def outlier_counts(df: DataFrame, columns: Sequence[str], factor: float = fixed.IQR_FACTOR) -> DataFrame:
    """Per column: the bounds and how many values lie outside them."""
    limits = as_struct(outlier_bounds(df, columns, factor))
    bounded = df.select(*columns).withColumn("_limits", limits)
    outside = [
        F.struct(
            F.lit(c).alias("column"),
            F.max(F.col("_limits")[c]["low"]).alias("lower_bound"),
            F.max(F.col("_limits")[c]["high"]).alias("upper_bound"),
            F.count_if((F.col(c) < F.col("_limits")[c]["low"]) | (F.col(c) > F.col("_limits")[c]["high"])).alias(
                "outliers"
            ),
        )
        for c in columns
    ]
    return bounded.agg(F.array(*outside).alias("_all")).select(F.inline("_all"))


def with_profile_labels(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Age group in four steps, income bracket and days since registration."""
    return df.withColumns(
        {
            "age_group": labels.age_group(F.col("age"), fixed.AGE_GROUPS_FOUR),
            "income_bracket": labels.income_bracket(F.col("income")),
            "days_since_registration": days_since(F.col("registration_date"), as_of),
        }
    )


def with_segments(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "customer_segment": labels.customer_segment(F.col("income"), F.col("credit_score")),
            "risk_score": labels.risk_score(F.col("credit_score")),
        }
    )
