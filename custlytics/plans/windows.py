"""Queries on windows and time series."""

from __future__ import annotations

from custlytics.operators import windows
from custlytics.plans.customer import CLEAN_SQL, enriched_customers
from custlytics.plans.registry import day, query, rounded
from custlytics.sources.tables import C_SQL, FEED_SQL, T_SQL, customers, transactions

RANK_SQL = (
    C_SQL
    + """,
ranked as (
  select customer_id, region, income,
    cast(row_number() over (partition by region order by income desc nulls last, customer_id) as bigint)
      as income_rank_in_region,
    cast(dense_rank() over (partition by region order by income desc nulls last) as bigint)
      as income_dense_rank_in_region,
    cast(ntile(10) over (partition by region order by income desc nulls last, customer_id) as bigint)
      as income_percentile
  from customers)
"""
)


@query(RANK_SQL + "select * from ranked")
def income_rank(spark, sf_dir):
    return windows.income_rank(customers(spark, sf_dir).select("customer_id", "region", "income"))


@query(RANK_SQL + "select customer_id, region, income, income_rank_in_region from ranked where income_rank_in_region <= 3")
def top_earners(spark, sf_dir):
    people = customers(spark, sf_dir).select("customer_id", "region", "income")
    return windows.top_within(people, ["region"], ["-income", "customer_id"], 3, "income_rank_in_region")


@query(
    T_SQL
    + """
select transaction_id, customer_id, cast(transaction_date as varchar) as transaction_date,
       round(lag(amount) over w, 4) as prev_transaction_amount, round(lead(amount) over w, 4) as next_transaction_amount,
       round(sum(amount) over (w rows between unbounded preceding and current row), 4) as running_total,
       cast(row_number() over w as bigint) as transaction_number
from transactions window w as (partition by customer_id order by transaction_date, transaction_id)"""
)
def tx_sequence(spark, sf_dir):
    bought = transactions(spark, sf_dir).select("transaction_id", "customer_id", "transaction_date", "amount")
    sequence = windows.transaction_sequence(bought)
    return sequence.select(
        "transaction_id", "customer_id", day("transaction_date"), rounded("prev_transaction_amount"),
        rounded("next_transaction_amount"), rounded("running_total"), "transaction_number",
    )


@query(
    C_SQL
    + """
select customer_id, region, cast(rank() over (partition by region order by credit_score nulls first) as bigint) as rank,
       first_value(customer_id) over w as first_key, last_value(customer_id) over w as last_key
from customers window w as (partition by region order by credit_score nulls first, customer_id
                            rows between unbounded preceding and unbounded following)"""
)
def rank_first_last(spark, sf_dir):
    people = customers(spark, sf_dir).select("customer_id", "region", "credit_score")
    ranked = windows.rank_first_last(people, "region", "credit_score", "customer_id")
    return ranked.select("customer_id", "region", "rank", "first_key", "last_key")


@query(
    C_SQL
    + """
select customer_id,
       round(case when count(income) over (order by customer_id rows 49 preceding) = 50
                  then avg(income) over (order by customer_id rows 49 preceding) end, 4) as income_rolling_mean,
       round(case when count(purchase_amount) over (order by customer_id rows 29 preceding) = 30
                  then sum(purchase_amount) over (order by customer_id rows 29 preceding) end, 4) as purchase_rolling_sum
from customers"""
)
def rolling_stats(spark, sf_dir):
    people = customers(spark, sf_dir).select("customer_id", "income", "purchase_amount")
    rolled = windows.rolling(
        people,
        "customer_id",
        {"income_rolling_mean": ("income", "mean", 50), "purchase_rolling_sum": ("purchase_amount", "sum", 30)},
    )
    return rolled.select("customer_id", rounded("income_rolling_mean"), rounded("purchase_rolling_sum"))


DAILY_SQL = (
    T_SQL
    + """,
daily as (
  select transaction_date, count(*) as daily_transactions, sum(amount) as daily_revenue,
         avg(amount) as avg_daily_transaction, count(distinct customer_id) as unique_customers
  from transactions group by transaction_date)
"""
)


@query(
    DAILY_SQL
    + """
select cast(transaction_date as varchar) as transaction_date, daily_transactions, round(daily_revenue, 4) as daily_revenue,
       round(avg_daily_transaction, 7) as avg_daily_transaction, unique_customers from daily"""
)
def daily_metrics(spark, sf_dir):
    return windows.daily_metrics(transactions(spark, sf_dir)).select(
        day("transaction_date"), "daily_transactions", rounded("daily_revenue"), rounded("avg_daily_transaction", 7),
        "unique_customers",
    )


@query(
    DAILY_SQL
    + """
select cast(transaction_date as varchar) as transaction_date,
       round(avg(daily_revenue) over (order by transaction_date rows 6 preceding), 4) as revenue_7day_ma,
       round(avg(daily_transactions) over (order by transaction_date rows 6 preceding), 4) as transactions_7day_ma,
       round((daily_revenue - lag(daily_revenue) over (order by transaction_date))
             / nullif(lag(daily_revenue) over (order by transaction_date), 0) * 100, 4) as revenue_growth
from daily"""
)
def daily_moving_avg(spark, sf_dir):
    averages = windows.moving_averages(windows.daily_metrics(transactions(spark, sf_dir)))
    return averages.select(
        day("transaction_date"), rounded("revenue_7day_ma"), rounded("transactions_7day_ma"), rounded("revenue_growth")
    )


@query(
    DAILY_SQL
    + """
select cast(transaction_date as varchar) as transaction_date,
       round(sum(daily_revenue) over (order by transaction_date rows unbounded preceding), 4) as cumulative_revenue,
       cast(sum(daily_transactions) over (order by transaction_date rows unbounded preceding) as bigint)
         as cumulative_transactions
from daily"""
)
def daily_cumulative(spark, sf_dir):
    totals = windows.cumulative(windows.daily_metrics(transactions(spark, sf_dir)))
    return totals.select(day("transaction_date"), rounded("cumulative_revenue"), "cumulative_transactions")


@query(
    FEED_SQL
    + CLEAN_SQL
    + """,
top as (
  select *, row_number() over (partition by customer_tier order by total_spent desc, customer_id) as tier_rank
  from enriched)
select customer_tier, age_group, count(customer_id) as top_customer_count, round(avg(total_spent), 4) as avg_top_spending,
       round(sum(total_transaction_amount), 4) as top_revenue
from top where tier_rank <= 10 group by customer_tier, age_group"""
)
def tier_top10(spark, sf_dir):
    top = windows.top_customers_by_tier(enriched_customers(spark, sf_dir))
    return top.select(
        "customer_tier", "age_group", "top_customer_count", rounded("avg_top_spending"), rounded("top_revenue")
    )
