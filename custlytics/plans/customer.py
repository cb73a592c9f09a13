"""Queries on customer analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from custlytics.operators import cleaning, customer
from custlytics.plans.registry import day, query, rounded
from custlytics.sources.tables import CT_SQL, FEED_SQL, T_SQL, customer_feed, customers, transactions

CLEAN_SQL = """,
cleaned as (
  select * from (select *, row_number() over (partition by customer_id order by version desc) as place
                 from customer_feed where customer_id is not null)
  where place = 1 and email is not null
),
grouped as (
  select *, case when age < 25 then 'Young' when age < 65 then 'Adult' else 'Senior' end as age_group
  from cleaned
),
metrics as (
  select customer_id, count(transaction_id) as transaction_count, sum(amount) as total_transaction_amount,
         avg(amount) as avg_transaction_amount
  from transactions group by customer_id
),
enriched as (
  select g.*, transaction_count, total_transaction_amount, avg_transaction_amount,
         case when total_transaction_amount > 10000 then 'Premium'
              when total_transaction_amount > 5000 then 'Gold'
              when total_transaction_amount > 1000 then 'Silver' else 'Bronze' end as customer_tier
  from grouped g left join metrics using (customer_id)
)"""


def cleaned_customers(spark, sf_dir):
    needed = customer_feed(spark, sf_dir).select("customer_id", "email", "age", "total_spent", "version")
    return cleaning.clean_customers(needed, first_by=[F.desc("version")])


def enriched_customers(spark, sf_dir):
    return customer.enrich_customers(cleaned_customers(spark, sf_dir), transactions(spark, sf_dir))


@query(
    FEED_SQL
    + CLEAN_SQL
    + """
select age_group, customer_tier, count(customer_id) as customer_count, round(avg(total_spent), 7) as avg_spending,
       round(sum(total_transaction_amount), 4) as total_revenue
from enriched group by age_group, customer_tier"""
)
def customer_insights(spark, sf_dir):
    insights = customer.customer_insights(enriched_customers(spark, sf_dir))
    return insights.select(
        "age_group", "customer_tier", "customer_count", rounded("avg_spending", 7), rounded("total_revenue")
    )


@query(FEED_SQL + CLEAN_SQL + "select customer_id, email, age, version, age_group from grouped")
def clean_customers(spark, sf_dir):
    return cleaned_customers(spark, sf_dir).select("customer_id", "email", "age", "version", "age_group")


@query(
    FEED_SQL
    + """
select customer_id, name, age, version from (
  select *, row_number() over (partition by customer_id order by version desc) as place from customer_feed)
where place = 1"""
)
def dedup_latest(spark, sf_dir):
    feed = customer_feed(spark, sf_dir).select("customer_id", "name", "age", "version")
    return cleaning.deduplicate(feed, ["customer_id"], [F.desc("version")])


@query(
    FEED_SQL
    + CLEAN_SQL
    + """
select customer_id, age_group, customer_tier, transaction_count,
       round(total_transaction_amount, 4) as total_transaction_amount,
       round(avg_transaction_amount, 7) as avg_transaction_amount
from enriched"""
)
def enrich_customers(spark, sf_dir):
    return enriched_customers(spark, sf_dir).select(
        "customer_id",
        "age_group",
        "customer_tier",
        "transaction_count",
        rounded("total_transaction_amount"),
        rounded("avg_transaction_amount", 7),
    )


@query(
    T_SQL
    + """
select customer_id, count(transaction_id) as transaction_count,
       round(sum(amount), 4) as total_transaction_amount, round(avg(amount), 7) as avg_transaction_amount
from transactions group by customer_id"""
)
def customer_tx_metrics(spark, sf_dir):
    return customer.transaction_metrics(transactions(spark, sf_dir)).select(
        "customer_id", "transaction_count", rounded("total_transaction_amount"), rounded("avg_transaction_amount", 7)
    )


LTV_SQL = (
    T_SQL
    + """,
ltv as (
  select customer_id, sum(amount) as total_spent, count(*) as transaction_count,
         date_diff('day', min(transaction_date), max(transaction_date)) as customer_lifetime_days,
         avg(amount) as avg_transaction_value
  from transactions group by customer_id
),
yearly as (
  select *, transaction_count / (customer_lifetime_days + 1) as transactions_per_day,
         transaction_count / (customer_lifetime_days + 1) * avg_transaction_value * 365 as estimated_annual_value
  from ltv
)
select customer_id, round(total_spent, 4) as total_spent, transaction_count,
       cast(customer_lifetime_days as integer) as customer_lifetime_days,
       round(avg_transaction_value, 7) as avg_transaction_value,
       round(transactions_per_day, 6) as transactions_per_day,
       round(estimated_annual_value, 6) as estimated_annual_value
from yearly"""
)


def _ltv_columns(df):
    return df.select(
        "customer_id",
        rounded("total_spent"),
        "transaction_count",
        "customer_lifetime_days",
        rounded("avg_transaction_value", 7),
        rounded("transactions_per_day", 6),
        rounded("estimated_annual_value", 6),
    )


@query(LTV_SQL)
def customer_ltv(spark, sf_dir):
    return _ltv_columns(customer.lifetime_value(transactions(spark, sf_dir)))


@query(LTV_SQL + " order by yearly.estimated_annual_value desc, customer_id limit 10")
def top_ltv(spark, sf_dir):
    ltv = customer.lifetime_value(transactions(spark, sf_dir))
    return _ltv_columns(ltv.orderBy(F.desc("estimated_annual_value"), "customer_id").limit(10))


RFM_SQL = (
    T_SQL
    + """,
base as (
  select customer_id, date_diff('day', max(transaction_date), date '2001-08-02') as recency,
         count(*) as frequency, sum(amount) as monetary
  from transactions group by customer_id
),
scored as (
  select *,
    case when recency <= 30 then 5 when recency <= 60 then 4 when recency <= 90 then 3
         when recency <= 180 then 2 else 1 end as recency_score,
    case when frequency >= 20 then 5 when frequency >= 15 then 4 when frequency >= 10 then 3
         when frequency >= 5 then 2 else 1 end as frequency_score,
    case when monetary >= 5000 then 5 when monetary >= 2000 then 4 when monetary >= 1000 then 3
         when monetary >= 500 then 2 else 1 end as monetary_score
  from base
)
select customer_id, cast(recency as integer) as recency, frequency, round(monetary, 4) as monetary,
       recency_score, frequency_score, monetary_score,
       recency_score || '' || frequency_score || monetary_score as rfm_score
from scored"""
)
# The day after the last order in the tables.
RFM_DAY = "2001-08-02"


def _rfm_columns(df):
    return df.select(
        "customer_id", "recency", "frequency", rounded("monetary"), "recency_score", "frequency_score",
        "monetary_score", "rfm_score",
    )


@query(RFM_SQL)
def rfm(spark, sf_dir):
    return _rfm_columns(customer.rfm(transactions(spark, sf_dir), RFM_DAY))


@query(RFM_SQL + " order by scored.monetary desc, customer_id limit 15")
def top_rfm(spark, sf_dir):
    scored = customer.rfm(transactions(spark, sf_dir), RFM_DAY)
    return _rfm_columns(scored.orderBy(F.desc("monetary"), "customer_id").limit(15))


@query(
    CT_SQL
    + """
select strftime(registration_date, '%Y-%m') as registration_month,
       strftime(transaction_date, '%Y-%m') as transaction_month,
       count(distinct customer_id) as active_customers, count(*) as transactions, round(sum(amount), 4) as revenue
from customers join transactions using (customer_id) group by 1, 2"""
)
def cohort_months(spark, sf_dir):
    months = customer.cohort_months(customers(spark, sf_dir), transactions(spark, sf_dir))
    return months.select(
        "registration_month", "transaction_month", "active_customers", "transactions", rounded("revenue")
    )


@query(
    T_SQL
    + """,
lines as (
  select customer_id, transaction_date, category, count(*) as quantity from transactions group by all
)
select customer_id, cast(transaction_date as varchar) as transaction_date,
       string_agg(category || ' x' || quantity, ', ' order by category) as basket,
       cast(sum(quantity) as bigint) as basket_size
from lines group by customer_id, transaction_date having sum(quantity) > 1"""
)
def baskets(spark, sf_dir):
    found = customer.baskets(transactions(spark, sf_dir))
    items = F.transform("basket", lambda e: F.concat(e["category"], F.lit(" x"), e["quantity"].cast("string")))
    return found.select(
        "customer_id", day("transaction_date"), F.array_join(items, ", ").alias("basket"), "basket_size"
    )


@query(
    T_SQL
    + """
select cast(month(transaction_date) as integer) as month, category, round(sum(amount), 4) as total_sales,
       count(*) as transaction_count, round(avg(amount), 7) as avg_transaction_value,
       month(transaction_date) || '-' || category as month_category
from transactions group by month(transaction_date), category"""
)
def seasonal(spark, sf_dir):
    return customer.seasonal(transactions(spark, sf_dir)).select(
        "month", "category", rounded("total_sales"), "transaction_count", rounded("avg_transaction_value", 7),
        "month_category",
    )


@query(
    T_SQL
    + """
select transaction_id, case when isodow(transaction_date) >= 6 then 1 else 0 end as is_weekend,
       cast(isodow(transaction_date) as integer) as day_of_week_num,
       round((amount - avg(amount) over ()) / stddev(amount) over (), 6) as amount_zscore
from transactions"""
)
def fraud_features(spark, sf_dir):
    return customer.fraud_features(transactions(spark, sf_dir)).select(
        "transaction_id", "is_weekend", "day_of_week_num", rounded("amount_zscore", 6)
    )


@query(
    T_SQL
    + """
select transaction_id, round((amount - (select avg(amount) from transactions))
                             / (select stddev(amount) from transactions), 6) as amount_zscore
from transactions"""
)
def amount_zscore(spark, sf_dir):
    scored = customer.zscore(transactions(spark, sf_dir), ["amount"])
    return scored.select("transaction_id", rounded("amount_zscore", 6))


@query(
    T_SQL
    + """
select customer_id, count(*) as total_transactions, count_if(amount > 1000)::bigint as high_value_transactions,
       string_agg(distinct strftime(transaction_date, '%a'), ',' order by strftime(transaction_date, '%a')) as active_days,
       string_agg(distinct category, ',' order by category) as preferred_categories,
       round(stddev(amount), 4) as spending_volatility,
       round(count_if(amount > 1000) / count(*), 6) as high_value_ratio,
       count(distinct strftime(transaction_date, '%a'))::integer as active_days_count,
       count(distinct category)::integer as category_diversity
from transactions group by customer_id"""
)
def customer_patterns(spark, sf_dir):
    found = customer.spending_patterns(transactions(spark, sf_dir))
    return found.select(
        "customer_id",
        "total_transactions",
        "high_value_transactions",
        F.array_join("active_days", ",").alias("active_days"),
        F.array_join("preferred_categories", ",").alias("preferred_categories"),
        rounded("spending_volatility"),
        rounded("high_value_ratio", 6),
        "active_days_count",
        "category_diversity",
    )


@query(
    T_SQL
    + """,
counted as (select customer_id, category, count(*) as n from transactions group by all)
select customer_id, string_agg(category || ' x' || n, ', ' order by category) as categories,
       string_agg(category, ', ' order by category) as unique_categories,
       count(*)::integer as category_count, bool_or(category = '1-URGENT') as prefers_online
from counted group by customer_id"""
)
def category_arrays(spark, sf_dir):
    found = customer.category_arrays(transactions(spark, sf_dir), wanted="1-URGENT")
    counted = F.transform("categories", lambda e: F.concat(e["category"], F.lit(" x"), e["n"].cast("string")))
    return found.select(
        "customer_id",
        F.array_join(counted, ", ").alias("categories"),
        F.array_join("unique_categories", ", ").alias("unique_categories"),
        "category_count",
        "prefers_online",
    )


@query(
    T_SQL
    + """
select customer_id, 0::bigint as part,
       string_agg(cast(round(amount * 100) as bigint), ' ' order by transaction_date, transaction_id) as amounts
from transactions group by customer_id"""
)
def amount_lists(spark, sf_dir):
    lists = customer.amount_lists(transactions(spark, sf_dir))
    cents = F.transform("amounts", lambda a: F.round(a * 100).cast("bigint").cast("string"))
    return lists.select("customer_id", "part", F.array_join(cents, " ").alias("amounts"))


@query(
    T_SQL
    + """
select category, round(sum(amount), 4) as total_amount,
       case when sum(amount) > 1000 then 'high' else 'low' end as status
from transactions where amount > 100 group by category"""
)
def category_status(spark, sf_dir):
    return customer.category_status(transactions(spark, sf_dir)).select(
        "category", rounded("total_amount"), "status"
    )
