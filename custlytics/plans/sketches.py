"""Queries on sketches that are written by day and merged."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from custlytics.operators import sketches
from custlytics.plans.registry import query, rounded
from custlytics.session import stored
from custlytics.sources.tables import T_SQL, transactions

#: Accepted errors: of a quantile's rank, and of a distinct count relative to the exact one.
RANK_ERROR, COUNT_ERROR = 0.03, 0.06
SHARES = {"median": 0.5, "p95": 0.95}


def _counts_well(exact: Column, estimate: Column) -> Column:
    return F.abs(estimate - exact) <= F.greatest(COUNT_ERROR * exact, F.lit(1))


@query(
    T_SQL
    + """
select category, count(*) as transactions, round(sum(amount), 2) as total, min(amount) as least, max(amount) as most,
       true as median_close, true as p95_close, true as customers_close
from transactions group by category"""
)
def category_stats_merged(spark, sf_dir):
    """Statistics by category from daily sketches. The ranks of the sketched quantiles and the distinct customers are
    held against the exact ones."""
    rows = transactions(spark, sf_dir)
    daily = stored(sketches.daily_sketches(rows))
    merged = sketches.merged_sketches(daily, ["category"])
    quantiles = {name: sketches.sketched_quantile(share) for name, share in SHARES.items()}
    found = stored(merged.withColumns({**quantiles, "customers": sketches.sketched_distinct()}).drop("values", "keys"))
    own = found.select(F.col("category").alias("own"), *SHARES, "customers")
    both = rows.join(F.broadcast(own), F.col("category").eqNullSafe(F.col("own"))).groupBy("own")

    def close(name: str, share: float) -> Column:
        below, upto = (F.count_if(test) / F.count("amount") for test in (F.col("amount") < F.col(name), F.col("amount") <= F.col(name)))
        return ((below <= share + RANK_ERROR) & (upto >= share - RANK_ERROR)).alias(f"{name}_close")

    customers = _counts_well(F.count_distinct("customer_id"), F.first("customers")).alias("customers_close")
    checked = both.agg(*[close(n, s) for n, s in SHARES.items()], customers)
    joined = found.join(checked, F.col("category").eqNullSafe(F.col("own")))
    return joined.select("category", F.col("rows").alias("transactions"), rounded("total", 2), "least", "most", "median_close", "p95_close", "customers_close")


@query(
    T_SQL
    + """
select strftime(transaction_date, '%Y-%m') as month, count(*) as transactions, true as customers_close
from transactions group by 1"""
)
def monthly_customers(spark, sf_dir):
    """Distinct customers of a month from the sketches of its days, held against the exact number."""
    rows = transactions(spark, sf_dir)
    month = F.date_format("day", "yyyy-MM").alias("month")
    daily = stored(sketches.daily_sketches(rows, []))
    found = sketches.merged_sketches(daily, [month]).withColumn("customers", sketches.sketched_distinct())
    exact = rows.groupBy(F.date_format("transaction_date", "yyyy-MM").alias("own")).agg(F.count_distinct("customer_id").alias("exact"))
    joined = found.join(exact, F.col("month").eqNullSafe(F.col("own")))
    return joined.select("month", F.col("rows").alias("transactions"), _counts_well(F.col("exact"), F.col("customers")).alias("customers_close"))
