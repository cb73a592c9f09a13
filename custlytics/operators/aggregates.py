"""Grouped and global summaries. Each takes one pass with partial aggregation before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from custlytics.operators.cleaning import categorical_columns, numeric_columns
from custlytics.operators.quantiles import as_struct, named, quantiles

# Bounds both the error (1 / accuracy) and the size of a percentile sketch.
SKETCH_ACCURACY = 10_000


def _rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def global_stats(customers: DataFrame, *, accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    return customers.agg(
        _rows("total_customers"),
        F.avg("age").alias("avg_age"),
        F.stddev("income").alias("income_stddev"),
        F.min("credit_score").alias("min_credit_score"),
        F.max("credit_score").alias("max_credit_score"),
        F.percentile_approx("income", 0.5, accuracy).alias("median_income"),
    )


def region_stats(customers: DataFrame, *, accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    return (
        customers.groupBy("region")
        .agg(
            _rows("customer_count"),
            F.avg("age").alias("avg_age"),
            F.avg("income").alias("avg_income"),
            F.stddev("income").alias("income_std"),
            F.percentile_approx("credit_score", 0.5, accuracy).alias("median_credit_score"),
        )
        .orderBy(F.desc("customer_count"), "region")
    )


def region_education_stats(customers: DataFrame) -> DataFrame:
    grouped = customers.groupBy("region", "education").agg(_rows("count"), F.avg("income").alias("avg_income"))
    return grouped.orderBy("region", "education")


def category_stats(transactions: DataFrame, *, accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    return (
        transactions.groupBy("category")
        .agg(
            _rows("transaction_count"),
            F.sum("amount").alias("total_amount"),
            F.avg("amount").alias("avg_amount"),
            F.percentile_approx("amount", [0.25, 0.5, 0.75], accuracy).alias("amount_quartiles"),
        )
        .orderBy(F.desc("total_amount"))
    )


def monthly_trends(transactions: DataFrame) -> DataFrame:
    """By month of the year, all years together."""
    return (
        transactions.groupBy(F.month("transaction_date").alias("month"))
        .agg(_rows("transaction_count"), F.sum("amount").alias("total_amount"), F.avg("amount").alias("avg_amount"))
        .orderBy("month")
    )


def segment_summary(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy("customer_segment").agg(
        _rows("count"), F.avg("income").alias("avg_income"), F.avg("credit_score").alias("avg_credit_score")
    )


def spending_by_category(transactions: DataFrame, categories: Sequence[str]) -> DataFrame:
    """One row per customer with ``<category>_total`` and ``<category>_count`` columns."""
    return (
        transactions.groupBy("customer_id")
        .pivot("category", list(categories))
        .agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("count"))
    )


def pivot_mean(df: DataFrame, rows: str, columns: str, value: str, labels: Sequence[str]) -> DataFrame:
    return df.groupBy(rows).pivot(columns, list(labels)).agg(F.avg(value))


def crosstab(df: DataFrame, rows: str, columns: str, labels: Sequence[str]) -> DataFrame:
    counted = df.groupBy(rows).pivot(columns, list(labels)).agg(F.count(F.lit(1)))
    return counted.fillna(0, list(labels))


def region_multi_aggregate(customers: DataFrame, digits: int = 2) -> DataFrame:
    """Several statistics of several columns by region, rounded."""
    wanted = {
        "income": (F.avg, F.stddev, F.min, F.max),
        "credit_score": (F.avg, F.stddev, F.count),
        "purchase_amount": (F.sum, F.avg),
        "age": (F.avg, F.min, F.max),
    }
    short = {F.avg: "mean", F.stddev: "std", F.min: "min", F.max: "max", F.count: "count", F.sum: "sum"}
    plain = customers.groupBy("region").agg(
        *[function(c).alias(f"{c}_{short[function]}") for c, functions in wanted.items() for function in functions]
    )
    medians = quantiles(customers, ["income", "purchase_amount"], [0.5], ["region"]).select(
        "region", F.col("income")[0].alias("income_median"), F.col("purchase_amount")[0].alias("purchase_amount_median")
    )
    joined = _with_groups(plain, medians, "region")
    return joined.select("region", *[F.round(c, digits).alias(c) for c in joined.columns if c != "region"])


def group_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, median, standard deviation and number of values per group."""
    plain = df.groupBy(by).agg(
        F.avg(value).alias("mean"), F.stddev(value).alias("std"), F.count(value).alias("count")
    )
    medians = quantiles(df, [value], [0.5], [by]).select(by, F.col(value)[0].alias("median"))
    return _with_groups(plain, medians, by)


def _with_groups(plain: DataFrame, more: DataFrame, by: str) -> DataFrame:
    """Further columns of the groups of ``plain``; the null group is one of them."""
    named = more.withColumnRenamed(by, "_by")
    return plain.join(named, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def percentile_table(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """One row per column and probability."""
    found = quantiles(df, columns, probabilities)
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("probability"), F.col(c)[i].alias("value"))
        for c in columns
        for i, p in enumerate(probabilities)
    ]
    return found.select(F.inline(F.array(*rows)))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles, one row per numeric column."""
    columns = list(columns or numeric_columns(df))
    quartiles = [0.25, 0.5, 0.75]
    summary = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in columns
        ]
    )
    found = as_struct(quantiles(df, columns, quartiles))
    rows = [
        F.struct(
            *[F.col(c)[part].alias(part) for part in ("column", "count", "mean", "std", "min", "max")],
            *[found[c][i].alias(named(p)) for i, p in enumerate(quartiles)],
        )
        for c in columns
    ]
    return summary.select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Number of rows per value of each categorical column, nulls left out."""
    columns = columns or categorical_columns(df)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return (
        df.select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(_rows("count"))
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    most_first = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    ranked = value_counts(df, columns).withColumn("place", F.row_number().over(most_first))
    return ranked.filter(F.col("place") <= k)


def distinct_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return value_counts(df, columns).groupBy("column").agg(_rows("distinct_values"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(_rows("count")).filter(F.col("count") > 1)
