"""Rankings, sequences, rolling statistics and daily time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from custlytics.operators.ordered import ordered_columns, sort_column


def income_rank(customers: DataFrame, *, max_group_rows: int | None = None) -> DataFrame:
    """Row number, dense rank and decile by falling income within the region."""
    return ordered_columns(
        customers,
        ["region"],
        ["-income"],
        ties=["customer_id"],
        running={
            "income_rank_in_region": "row_number",
            "income_dense_rank_in_region": "dense_rank",
            "income_percentile": ("ntile", 10),
        },
        max_group_rows=max_group_rows,
    )


def top_within(df: DataFrame, by: Sequence[str], order: Sequence[str], k: int, name: str = "place") -> DataFrame:
    """The first ``k`` rows of each group.

    Spark cuts each group to ``k`` rows per task before the shuffle, so group size does not matter.
    """
    window = Window.partitionBy(*by).orderBy(*map(sort_column, order))
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)


def transaction_sequence(transactions: DataFrame, *, max_group_rows: int | None = None) -> DataFrame:
    """Previous and next amount, running total and ordinal of each customer's transactions."""
    return ordered_columns(
        transactions,
        ["customer_id"],
        ["transaction_date"],
        ties=["transaction_id"],
        running={"transaction_number": "row_number", "running_total": ("sum", "amount")},
        framed={
            "prev_transaction_amount": lambda w: F.lag("amount").over(w),
            "next_transaction_amount": lambda w: F.lead("amount").over(w),
        },
        before=1,
        after=1,
        max_group_rows=max_group_rows,
    )


def rank_first_last(
    df: DataFrame, by: str, order: str, key: str, *, max_group_rows: int | None = None
) -> DataFrame:
    """Rank with gaps, and the key of the group's first and last row."""
    return ordered_columns(
        df,
        [by],
        [order],
        ties=[key],
        running={"rank": "rank", "first_key": ("first", key), "last_key": ("last", key)},
        max_group_rows=max_group_rows,
    )


def rolling(
    df: DataFrame,
    order: str,
    specs: dict[str, tuple[str, str, int]],
    *,
    max_group_rows: int | None = None,
) -> DataFrame:
    """Rolling means and sums over the whole table in ``order`` (a unique column).

    ``specs`` maps a new column to (column, ``"mean"`` or ``"sum"``, rows). A result is null until the
    window is full and while it contains a null.
    """
    functions = {"mean": F.avg, "sum": F.sum}

    def build(column: str, function: str, rows: int):
        def over(window):
            frame = window.rowsBetween(-(rows - 1), Window.currentRow)
            return F.when(F.count(column).over(frame) == rows, functions[function](column).over(frame))

        return over

    return ordered_columns(
        df,
        [],
        [order],
        framed={name: build(*spec) for name, spec in specs.items()},
        before=max(rows for _, _, rows in specs.values()) - 1,
        max_group_rows=max_group_rows,
    )


def daily_metrics(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("transaction_date").agg(
        F.count(F.lit(1)).alias("daily_transactions"),
        F.sum("amount").alias("daily_revenue"),
        F.avg("amount").alias("avg_daily_transaction"),
        F.countDistinct("customer_id").alias("unique_customers"),
    )


def _by_day() -> WindowSpec:
    """The daily table has one row per calendar day, at most 3.7 million for all days a date can hold,
    however many transactions there are. So its windows need no partitioning."""
    return Window.orderBy("transaction_date")


def moving_averages(daily: DataFrame, days: int = 7) -> DataFrame:
    """Means over the last ``days`` rows (fewer at the start) and growth over the previous row in percent."""
    recent = _by_day().rowsBetween(-(days - 1), Window.currentRow)
    previous = F.lag("daily_revenue").over(_by_day())
    return daily.withColumns(
        {
            f"revenue_{days}day_ma": F.avg("daily_revenue").over(recent),
            f"transactions_{days}day_ma": F.avg("daily_transactions").over(recent),
            "revenue_growth": F.try_divide(F.col("daily_revenue") - previous, previous) * 100,
        }
    )


def cumulative(daily: DataFrame) -> DataFrame:
    so_far = _by_day().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.withColumns(
        {
            "cumulative_revenue": F.sum("daily_revenue").over(so_far),
            "cumulative_transactions": F.sum("daily_transactions").over(so_far),
        }
    )


def top_customers_by_tier(enriched: DataFrame, k: int = 10) -> DataFrame:
    """Summary by tier and age group of the ``k`` biggest spenders of each tier."""
    top = top_within(enriched, ["customer_tier"], ["-total_spent", "customer_id"], k)
    return (
        top.groupBy("customer_tier", "age_group")
        .agg(
            F.count("customer_id").alias("top_customer_count"),
            F.avg("total_spent").alias("avg_top_spending"),
            F.sum("total_transaction_amount").alias("top_revenue"),
        )
        .orderBy("customer_tier", F.desc("top_revenue"))
    )
