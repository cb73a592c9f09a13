"""Queries on data quality and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from custlytics.functions import fixed_values as fixed
from custlytics.operators import cleaning, quality, stats
from custlytics.plans.registry import query, rounded
from custlytics.session import scratch_path
from custlytics.sources import writers
from custlytics.sources.tables import C_SQL, T_SQL, customers, transactions

PROFILED = [
    "customer_id", "name", "email", "age", "income", "credit_score", "years_employed", "debt_ratio", "region",
    "education", "marital_status", "has_mortgage", "num_accounts", "registration_date", "last_login",
    "purchase_amount", "total_spent",
]
CORRELATED = ["age", "income", "credit_score", "years_employed"]
MEASURES = ["age", "income", "credit_score", "years_employed", "debt_ratio", "purchase_amount", "total_spent"]


def _null_lines() -> str:
    return " union all ".join(
        f"select '{c}' as \"column\", count(*) - count({c}) as nulls, "
        f"round((count(*) - count({c})) / count(*) * 100, 6) as null_percentage from customers"
        for c in PROFILED
    )


@query(C_SQL + _null_lines())
def null_profile(spark, sf_dir):
    return quality.null_profile(customers(spark, sf_dir)).select("column", "nulls", rounded("null_percentage", 6))


@query(
    C_SQL
    + """
select 'age' as rule, count(*) filter (age < 18 or age > 100) as violations from customers
union all select 'income', count(*) filter (income < 0) from customers
union all select 'credit_score', count(*) filter (credit_score < 300 or credit_score > 850) from customers
union all select 'credit_below_700', count(*) filter (credit_score >= 700) from customers
union all select 'working_age', count(*) filter (age < 18 or age > 64) from customers"""
)
def range_checks(spark, sf_dir):
    own = (("credit_below_700", "credit_score", None, 699), ("working_age", "age", 18, 64))
    return quality.range_checks(customers(spark, sf_dir), fixed.VALID_RANGES + own)


@query(
    C_SQL
    + "select 'rows' as metric, count(*) as value from customers union all "
    + " union all ".join(f"select 'nulls_{c}', count(*) - count({c}) from customers" for c in PROFILED)
    + """
union all select 'violations_age', count(*) filter (age < 18 or age > 100) from customers
union all select 'violations_income', count(*) filter (income < 0) from customers
union all select 'violations_credit_score', count(*) filter (credit_score < 300 or credit_score > 850) from customers"""
)
def observed_quality(spark, sf_dir):
    """Null counts and range checks taken while the customers are written."""
    path = scratch_path(spark, "customers-observed")
    metrics = writers.save_results(customers(spark, sf_dir), path, observe=quality.checks(PROFILED))
    return spark.createDataFrame(sorted(metrics.items()), "metric string, value bigint")


def _corr_sql(columns, source, with_self, where="") -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i if with_self else i + 1 :]]
    lines = " union all ".join(
        f"select '{a}' as feature1, '{b}' as feature2, corr({a}, {b}) as r from {source}" for a, b in pairs
    )
    return f"select feature1, feature2, round(r, 8) as correlation from ({lines}) {where}"


@query(
    C_SQL
    + """,
filled as (
  select age, years_employed, coalesce(income, avg(income) over ()) as income,
         coalesce(credit_score, avg(credit_score) over ()) as credit_score from customers)
"""
    + _corr_sql(CORRELATED, "filled", True)
)
def corr_pairs(spark, sf_dir):
    filled = cleaning.impute(customers(spark, sf_dir), ["income", "credit_score"])
    return stats.corr_pairs(filled, CORRELATED).select("feature1", "feature2", rounded("correlation", 8))


@query(C_SQL + _corr_sql(MEASURES, "customers", False, "where abs(r) > 0.7"))
def high_corr_pairs(spark, sf_dir):
    pairs = stats.corr_pairs(customers(spark, sf_dir), MEASURES, with_self=False, stronger_than=0.7)
    return pairs.select("feature1", "feature2", rounded("correlation", 8))


@query("select unnest([0.25, 0.5, 0.75, 0.9])::double as probability, true as near_its_rank")
def approx_quantile_ranks(spark, sf_dir):
    """Whether the shares of rows below and up to each approximate quantile enclose its probability, give
    or take the error that was asked for."""
    filled = cleaning.impute(customers(spark, sf_dir), ["income"]).select("income")
    error = 0.05
    found = stats.approx_quantiles(filled, "income", [0.25, 0.5, 0.75, 0.9], error)
    quantiles = found.agg(F.collect_list(F.struct("probability", "value"))).scalar()
    counted = filled.withColumn("q", F.explode(quantiles)).groupBy("q.probability").agg(
        F.avg(F.when(F.col("income") < F.col("q.value"), 1).otherwise(0)).alias("below"),
        F.avg(F.when(F.col("income") <= F.col("q.value"), 1).otherwise(0)).alias("upto"),
    )
    near = (F.col("below") - error <= F.col("probability")) & (F.col("probability") <= F.col("upto") + error)
    return counted.select("probability", near.alias("near_its_rank"))


@query(None)
def approx_quantiles(spark, sf_dir):
    filled = cleaning.impute(customers(spark, sf_dir), ["income"])
    return stats.approx_quantiles(filled, "income", [0.25, 0.5, 0.75, 0.9])


@query(
    T_SQL
    + """
select 'category' as "column", category as value, count(*) as count from transactions group by category
having count(*) >= 0.3 * (select count(*) from transactions)
union all
select 'is_fraud', cast(is_fraud as varchar), count(*) from transactions group by is_fraud
having count(*) >= 0.3 * (select count(*) from transactions)"""
)
def frequent_items(spark, sf_dir):
    bought = transactions(spark, sf_dir)
    parts = [
        stats.frequent_items(bought, c).select(F.lit(c).alias("column"), F.col("value").cast("string"), "count")
        for c in ("category", "is_fraud")
    ]
    return parts[0].unionByName(parts[1])


def _moments_sql(columns) -> str:
    line = """
select '{c}' as "column", round(variance({c}), 4) as variance,
       round(avg(power({c} - m, 3)) / power(var_pop({c}), 1.5), 6) as skewness,
       round(avg(power({c} - m, 4)) / power(var_pop({c}), 2) - 3, 6) as kurtosis,
       count(*) - count({c}) as nulls, count(*) filter (isnan({c}::double)) as nans
from (select {c}, avg({c}) over () as m from customers)"""
    return " union all ".join(line.format(c=c) for c in columns)


@query(C_SQL + _moments_sql(["income", "credit_score", "purchase_amount"]))
def moments(spark, sf_dir):
    found = stats.moments(customers(spark, sf_dir), ["income", "credit_score", "purchase_amount"])
    return found.select(
        "column", rounded("variance"), rounded("skewness", 6), rounded("kurtosis", 6), "nulls", "nans"
    )
