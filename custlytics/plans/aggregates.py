"""Queries on aggregates and pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from custlytics.functions import fixed_values as fixed
from custlytics.operators import aggregates
from custlytics.plans.registry import query, rounded
from custlytics.sources.tables import C_SQL, FEED_SQL, PRIORITIES, T_SQL, customer_feed, customers, transactions

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
EDUCATIONS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
NUMERIC = ["age", "income", "credit_score", "years_employed", "debt_ratio", "num_accounts", "purchase_amount"]
CATEGORICAL = ["region", "education", "marital_status", "has_mortgage"]


@query(
    C_SQL
    + """
select count(*) as total_customers, round(avg(age), 6) as avg_age, round(stddev(income), 4) as income_stddev,
       min(credit_score) as min_credit_score, max(credit_score) as max_credit_score,
       quantile_disc(income, 0.5) as median_income
from customers"""
)
def global_stats(spark, sf_dir):
    stats = aggregates.global_stats(customers(spark, sf_dir))
    return stats.withColumns({"avg_age": F.round("avg_age", 6), "income_stddev": F.round("income_stddev", 4)})


@query(
    C_SQL
    + """
select region, count(*) as customer_count, round(avg(age), 6) as avg_age, round(avg(income), 7) as avg_income,
       round(stddev(income), 4) as income_std, quantile_disc(credit_score, 0.5) as median_credit_score
from customers group by region"""
)
def region_stats(spark, sf_dir):
    stats = aggregates.region_stats(customers(spark, sf_dir))
    return stats.select(
        "region", "customer_count", rounded("avg_age", 6), rounded("avg_income", 7), rounded("income_std"),
        "median_credit_score",
    )


@query(
    C_SQL
    + """
select region, education, count(*) as count, round(avg(income), 4) as avg_income
from customers group by region, education"""
)
def region_education_stats(spark, sf_dir):
    stats = aggregates.region_education_stats(customers(spark, sf_dir))
    return stats.select("region", "education", "count", rounded("avg_income"))


@query(
    T_SQL
    + """
select category, count(*) as transaction_count, round(sum(amount), 4) as total_amount,
       round(avg(amount), 4) as avg_amount, quantile_disc(amount, 0.25) as amount_p25,
       quantile_disc(amount, 0.5) as amount_p50, quantile_disc(amount, 0.75) as amount_p75
from transactions group by category"""
)
def category_stats(spark, sf_dir):
    stats = aggregates.category_stats(transactions(spark, sf_dir))
    quartiles = [F.col("amount_quartiles")[i].alias(name) for i, name in enumerate(("amount_p25", "amount_p50", "amount_p75"))]
    return stats.select("category", "transaction_count", rounded("total_amount"), rounded("avg_amount"), *quartiles)


@query(
    T_SQL
    + """
select cast(month(transaction_date) as integer) as month, count(*) as transaction_count,
       round(sum(amount), 4) as total_amount, round(avg(amount), 4) as avg_amount
from transactions group by month(transaction_date)"""
)
def monthly_trends(spark, sf_dir):
    trends = aggregates.monthly_trends(transactions(spark, sf_dir))
    return trends.select("month", "transaction_count", rounded("total_amount"), rounded("avg_amount"))


def _pivot_sql() -> str:
    parts = []
    for c in PRIORITIES:
        name = c.replace("-", "_").replace(" ", "_")
        parts.append(f"round(sum(amount) filter (category = '{c}'), 4) as total_{name}")
        parts.append(f"nullif(count(*) filter (category = '{c}'), 0) as count_{name}")
    return T_SQL + f"select customer_id, {', '.join(parts)} from transactions group by customer_id"


@query(_pivot_sql())
def pivot_spend(spark, sf_dir):
    pivoted = aggregates.spending_by_category(transactions(spark, sf_dir), PRIORITIES)
    columns = []
    for c in PRIORITIES:
        name = c.replace("-", "_").replace(" ", "_")
        columns.append(F.round(F.col(f"`{c}_total`"), 4).alias(f"total_{name}"))
        columns.append(F.col(f"`{c}_count`").alias(f"count_{name}"))
    return pivoted.select("customer_id", *columns)


@query(
    C_SQL
    + "select education, "
    + ", ".join(f"round(avg(credit_score) filter (region = '{r}'), 6) as \"{r}\"" for r in REGIONS)
    + " from customers group by education"
)
def pivot_credit(spark, sf_dir):
    pivoted = aggregates.pivot_mean(customers(spark, sf_dir), "education", "region", "credit_score", REGIONS)
    return pivoted.select("education", *[F.round(F.col(f"`{r}`"), 6).alias(r) for r in REGIONS])


@query(
    C_SQL
    + "select region, "
    + ", ".join(f"count(*) filter (education = '{e}') as {e.lower()}" for e in EDUCATIONS)
    + " from customers group by region"
)
def crosstab(spark, sf_dir):
    table = aggregates.crosstab(customers(spark, sf_dir), "region", "education", EDUCATIONS)
    return table.select("region", *[F.col(e).alias(e.lower()) for e in EDUCATIONS])


@query(
    C_SQL
    + """
select region, round(avg(income), 7) as income_mean, round(median(income), 7) as income_median,
       round(stddev(income), 7) as income_std, round(min(income), 7) as income_min, round(max(income), 7) as income_max,
       round(avg(credit_score), 7) as credit_score_mean, round(stddev(credit_score), 7) as credit_score_std,
       count(credit_score) as credit_score_count, round(sum(purchase_amount), 7) as purchase_amount_sum,
       round(avg(purchase_amount), 7) as purchase_amount_mean, round(median(purchase_amount), 7) as purchase_amount_median,
       round(avg(age), 7) as age_mean, min(age) as age_min, max(age) as age_max
from customers group by region"""
)
def region_multi_agg(spark, sf_dir):
    return aggregates.region_multi_aggregate(customers(spark, sf_dir), digits=7)


@query(
    C_SQL
    + """
select 'region' as grouping, region as label, round(avg(purchase_amount), 4) as mean,
       round(median(purchase_amount), 4) as median, round(stddev(purchase_amount), 4) as std,
       count(purchase_amount) as count
from customers group by region
union all
select 'education', education, round(avg(income), 4), round(median(income), 4), round(stddev(income), 4), count(income)
from customers group by education"""
)
def group_summaries(spark, sf_dir):
    people = customers(spark, sf_dir)
    parts = [
        aggregates.group_summary(people, by, value).select(
            F.lit(by).alias("grouping"), F.col(by).alias("label"), rounded("mean"), rounded("median"), rounded("std"),
            "count",
        )
        for by, value in (("region", "purchase_amount"), ("education", "income"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    C_SQL
    + """,
tall as (
  unpivot (select cast(income as double) as income, cast(credit_score as double) as credit_score, purchase_amount
           from customers) on income, credit_score, purchase_amount into name "column" value v),
points as (select unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) as probability),
found as (
  select "column", quantile_cont(v, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) as q from tall group by "column")
select "column", unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])::double as probability, round(unnest(q), 4) as value
from found"""
)
def percentile_table(spark, sf_dir):
    table = aggregates.percentile_table(
        customers(spark, sf_dir), ["income", "credit_score", "purchase_amount"], fixed.REPORT_PERCENTILES
    )
    return table.select("column", "probability", rounded("value"))


@query(
    C_SQL
    + ",tall as (unpivot (select "
    + ", ".join(f"cast({c} as double) as {c}" for c in NUMERIC)
    + f' from customers) on {", ".join(NUMERIC)} into name "column" value v)'
    + """
select "column", count(v) as count, round(avg(v), 4) as mean, round(stddev(v), 4) as std, min(v) as min,
       round(quantile_cont(v, 0.25), 4) as p25, round(quantile_cont(v, 0.5), 4) as p50,
       round(quantile_cont(v, 0.75), 4) as p75, max(v) as max
from tall group by "column" """
)
def describe_numeric(spark, sf_dir):
    return aggregates.describe(customers(spark, sf_dir), NUMERIC).select(
        "column", "count", rounded("mean"), rounded("std"), "min", rounded("p25"), rounded("p50"), rounded("p75"), "max"
    )


TALL_SQL = C_SQL + ",tall as (" + " union all ".join(
    f"select '{c}' as \"column\", cast({c} as varchar) as value from customers" for c in CATEGORICAL
) + '), counted as (select "column", value, count(*) as count from tall where value is not null group by all)'


@query(
    TALL_SQL
    + """,
ranked as (select *, row_number() over (partition by "column" order by count desc, value) as place from counted)
select "column", value, count, cast(place as integer) as place from ranked where place <= 5"""
)
def top_values(spark, sf_dir):
    return aggregates.top_values(customers(spark, sf_dir), CATEGORICAL)


@query(TALL_SQL + 'select "column", count(*) as distinct_values from counted group by "column"')
def distinct_values(spark, sf_dir):
    return aggregates.distinct_values(customers(spark, sf_dir), CATEGORICAL)


@query(FEED_SQL + "select customer_id, count(*) as count from customer_feed group by customer_id having count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return aggregates.duplicate_keys(customer_feed(spark, sf_dir), ["customer_id"])
