"""The customer job from files to files: load, clean, enrich, summarise, save."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from custlytics.operators.cleaning import clean_customers
from custlytics.operators.customer import customer_insights, enrich_customers
from custlytics.sources.readers import read_customers, read_transactions
from custlytics.sources.writers import save_results


def run(
    spark: SparkSession,
    customer_path: str,
    transaction_path: str,
    output_path: str,
    *,
    validator: Callable[[DataFrame], DataFrame] | None = None,
    first_by: Sequence[Column] = (),
    multi_line: bool = False,
) -> DataFrame:
    """Write ``enriched_customers`` (parquet) and ``customer_insights`` (CSV) and return the insights.

    The insights are computed from the written customers, so loading, cleaning and joining run once.
    """
    cleaned = clean_customers(read_customers(spark, customer_path), validator=validator, first_by=first_by)
    transactions = read_transactions(spark, transaction_path, multi_line=multi_line)
    enriched_path, insights_path = f"{output_path}/enriched_customers", f"{output_path}/customer_insights"
    save_results(enrich_customers(cleaned, transactions), enriched_path)
    insights = customer_insights(spark.read.parquet(enriched_path))
    save_results(insights, insights_path, "csv", num_files=1)
    return insights
