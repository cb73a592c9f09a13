"""Customer analytics: enrichment, insights, lifetime value, RFM, cohorts, baskets, spending patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from custlytics.functions import dates, fixed_values as fixed, labels
from custlytics.operators.ordered import ordered_columns


def transaction_metrics(transactions: DataFrame) -> DataFrame:
    """Per customer: number, sum and mean of the transaction amounts."""
    return transactions.groupBy("customer_id").agg(
        F.count("transaction_id").alias("transaction_count"),
        F.sum("amount").alias("total_transaction_amount"),
        F.avg("amount").alias("avg_transaction_amount"),
    )


def enrich_customers(customers: DataFrame, transactions: DataFrame, *, tiers=fixed.CUSTOMER_TIERS) -> DataFrame:
    """All customers with their transaction metrics (null without transactions) and a tier."""
    enriched = customers.join(transaction_metrics(transactions), "customer_id", "left")
    return enriched.withColumn("customer_tier", labels.customer_tier(F.col("total_transaction_amount"), tiers))


def customer_insights(enriched: DataFrame) -> DataFrame:
    return (
        enriched.groupBy("age_group", "customer_tier")
        .agg(
            F.count("customer_id").alias("customer_count"),
            F.avg("total_spent").alias("avg_spending"),
            F.sum("total_transaction_amount").alias("total_revenue"),
        )
        .orderBy("age_group", "customer_tier")
    )


def lifetime_value(transactions: DataFrame) -> DataFrame:
    """Totals per customer and the yearly value at the customer's own pace."""
    per_customer = transactions.groupBy("customer_id").agg(
        F.sum("amount").alias("total_spent"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.datediff(F.max("transaction_date"), F.min("transaction_date")).alias("customer_lifetime_days"),
        F.avg("amount").alias("avg_transaction_value"),
    )
    pace = F.col("transaction_count") / (F.col("customer_lifetime_days") + 1)
    return per_customer.withColumns(
        {
            "transactions_per_day": pace,
            "estimated_annual_value": pace * F.col("avg_transaction_value") * fixed.DAYS_PER_YEAR,
        }
    )


def rfm(transactions: DataFrame, as_of: str = fixed.RFM_REFERENCE_DATE) -> DataFrame:
    """Recency, frequency and monetary value with scores from 1 to 5 and their three-digit code."""
    per_customer = transactions.groupBy("customer_id").agg(
        F.datediff(F.lit(as_of).cast("date"), F.max("transaction_date")).alias("recency"),
        F.count(F.lit(1)).alias("frequency"),
        F.sum("amount").alias("monetary"),
    )
    scored = per_customer.withColumns(
        {
            "recency_score": labels.at_most(F.col("recency"), fixed.RECENCY_SCORES, fixed.RFM_SCORE_OTHER),
            "frequency_score": labels.at_least(F.col("frequency"), fixed.FREQUENCY_SCORES, fixed.RFM_SCORE_OTHER),
            "monetary_score": labels.at_least(F.col("monetary"), fixed.MONETARY_SCORES, fixed.RFM_SCORE_OTHER),
        }
    )
    return scored.withColumn("rfm_score", F.concat("recency_score", "frequency_score", "monetary_score"))


def with_month(df: DataFrame, day_column: str, name: str) -> DataFrame:
    return df.withColumn(name, dates.month_label(F.col(day_column)))


def cohort_months(customers: DataFrame, transactions: DataFrame) -> DataFrame:
    """Activity of each registration month's customers in each transaction month.

    Transactions are reduced to one row per customer and month before the join.
    """
    activity = (
        with_month(transactions, "transaction_date", "transaction_month")
        .groupBy("customer_id", "transaction_month")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("revenue"))
    )
    # Second records of a customer do not count again: the first registration is the customer's.
    first = customers.groupBy("customer_id").agg(F.min("registration_date").alias("registration_date"))
    cohorts = with_month(first, "registration_date", "registration_month").select("customer_id", "registration_month")
    return (
        cohorts.join(activity, "customer_id")
        .groupBy("registration_month", "transaction_month")
        .agg(
            F.count(F.lit(1)).alias("active_customers"),
            F.sum("n").alias("transactions"),
            F.sum("revenue").alias("revenue"),
        )
    )


def baskets(transactions: DataFrame) -> DataFrame:
    """Days on which a customer bought more than once.

    A basket lists each category once with its quantity, sorted by category. It holds the same items
    as a flat list would but is never longer than the number of categories, however busy the day.
    """
    lines = transactions.groupBy("customer_id", "transaction_date", "category").agg(
        F.count(F.lit(1)).alias("quantity")
    )
    return (
        lines.groupBy("customer_id", "transaction_date")
        .agg(
            F.sort_array(F.collect_list(F.struct("category", "quantity"))).alias("basket"),
            F.sum("quantity").alias("basket_size"),
        )
        .filter(F.col("basket_size") > 1)
    )


def seasonal(transactions: DataFrame) -> DataFrame:
    return (
        transactions.groupBy(F.month("transaction_date").alias("month"), "category")
        .agg(
            F.sum("amount").alias("total_sales"),
            F.count(F.lit(1)).alias("transaction_count"),
            F.avg("amount").alias("avg_transaction_value"),
        )
        .withColumn("month_category", F.concat_ws("-", F.col("month").cast("string"), F.col("category")))
        .orderBy("month", F.desc("total_sales"))
    )


def zscore(df: DataFrame, columns: Sequence[str], *, population: bool = False, suffix: str = "_zscore") -> DataFrame:
    """Distance from the column mean in standard deviations; null where the deviation is 0."""
    deviation = F.stddev_pop if population else F.stddev
    moments = df.agg(
        F.struct(*[F.struct(F.avg(c).alias("mean"), deviation(c).alias("deviation")).alias(c) for c in columns])
    ).scalar()
    return df.withColumns(
        {
            f"{c}{suffix}": F.try_divide(
                F.col(c) - moments[c]["mean"], F.nullif(moments[c]["deviation"], F.lit(0.0))
            )
            for c in columns
        }
    )


def fraud_features(transactions: DataFrame) -> DataFrame:
    day = F.col("transaction_date")
    scored = zscore(transactions, ["amount"])
    return scored.withColumns({"is_weekend": dates.is_weekend(day), "day_of_week_num": dates.iso_weekday(day)})


def spending_patterns(transactions: DataFrame, high_value: float = fixed.HIGH_VALUE_AMOUNT) -> DataFrame:
    day = dates.weekday_name(F.col("transaction_date"))
    per_customer = transactions.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(F.col("amount") > high_value).alias("high_value_transactions"),
        F.sort_array(F.collect_set(day)).alias("active_days"),
        F.sort_array(F.collect_set("category")).alias("preferred_categories"),
        F.stddev("amount").alias("spending_volatility"),
    )
    return per_customer.withColumns(
        {
            "high_value_ratio": F.col("high_value_transactions") / F.col("total_transactions"),
            "active_days_count": F.size("active_days"),
            "category_diversity": F.size("preferred_categories"),
        }
    )


def category_arrays(transactions: DataFrame, wanted: str = "Online") -> DataFrame:
    """Per customer: categories with their counts, the set of categories, and whether ``wanted`` is one.

    The counts stand for the list of all categories; they are bounded by the number of categories,
    the list is not.
    """
    per_category = transactions.groupBy("customer_id", "category").agg(F.count(F.lit(1)).alias("n"))
    entries = F.sort_array(F.collect_list(F.struct("category", "n")))
    return (
        per_category.groupBy("customer_id")
        .agg(entries.alias("categories"))
        .withColumn("unique_categories", F.transform("categories", lambda e: e["category"]))
        .withColumns(
            {
                "category_count": F.size("unique_categories"),
                "prefers_online": F.array_contains("unique_categories", wanted),
            }
        )
    )


def category_status(transactions: DataFrame, min_amount: float = 100, high_total: float = 1000) -> DataFrame:
    """Totals of the amounts above ``min_amount`` per category, marked high or low."""
    return (
        transactions.filter(F.col("amount") > min_amount)
        .groupBy("category")
        .agg(F.sum("amount").alias("total_amount"))
        .withColumn("status", F.when(F.col("total_amount") > high_total, "high").otherwise("low"))
    )


def amount_lists(transactions: DataFrame, *, list_rows: int = 10_000) -> DataFrame:
    """All amounts of each customer in date order, as lists of at most ``list_rows`` amounts.

    Ordinary customers have one list (part 0); very busy ones have several, so no list outgrows a task.
    """
    numbered = ordered_columns(
        transactions.select("customer_id", "transaction_date", "transaction_id", "amount"),
        ["customer_id"],
        ["transaction_date"],
        ties=["transaction_id"],
        running={"_number": "row_number"},
    )
    part = F.floor((F.col("_number") - 1) / list_rows)
    in_order = F.sort_array(F.collect_list(F.struct("_number", "amount")))
    return (
        numbered.groupBy("customer_id", part.alias("part"))
        .agg(in_order.alias("_entries"))
        .select("customer_id", "part", F.transform("_entries", lambda e: e["amount"]).alias("amounts"))
    )
