"""Queries on joins, unions and physical layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from custlytics.operators import cleaning, joins
from custlytics.plans.registry import day, query, rounded
from custlytics.sources.tables import C_SQL, CT_SQL, CTP_SQL, customers, products, transactions


@query(
    CT_SQL
    + """
select customer_id, transaction_id, region, education, category, round(amount, 4) as amount
from customers join transactions using (customer_id)"""
)
def customer_tx_inner(spark, sf_dir):
    joined = joins.customer_transactions(customers(spark, sf_dir), transactions(spark, sf_dir))
    return joined.select("customer_id", "transaction_id", "region", "education", "category", rounded("amount"))


@query(
    CT_SQL
    + """,
summary as (
  select customer_id, count(*) as n, sum(amount) as total, avg(amount) as mean, max(transaction_date) as latest
  from transactions group by customer_id)
select customer_id, region, coalesce(n, 0) as transaction_count, round(coalesce(total, 0), 4) as total_spent,
       round(coalesce(mean, 0), 7) as avg_transaction_amount, cast(latest as varchar) as last_transaction_date
from customers left join summary using (customer_id)"""
)
def customer_summary_left(spark, sf_dir):
    people = customers(spark, sf_dir).select("customer_id", "region")
    joined = joins.customers_with_summary(people, transactions(spark, sf_dir))
    return joined.select(
        "customer_id", "region", "transaction_count", rounded("total_spent"), rounded("avg_transaction_amount", 7),
        day("last_transaction_date"),
    )


@query(
    C_SQL
    + """
select a.customer_id as customer1, b.customer_id as customer2, a.region as region, a.income as income1,
       b.income as income2, round(abs(a.income - b.income), 6) as gap
from customers a join customers b on a.region = b.region and a.customer_id <> b.customer_id
  and abs(a.income - b.income) < 5000
order by abs(a.income - b.income), a.customer_id, b.customer_id limit 20"""
)
def similar_income(spark, sf_dir):
    pairs = joins.closest_incomes(customers(spark, sf_dir))
    return pairs.select("customer1", "customer2", "region", "income1", "income2", rounded("gap", 6))


@query(
    CT_SQL
    + """
select customer_id, region from customers where income > 90000
union
select customer_id, region from customers
join (select customer_id from transactions group by customer_id having count(*) > 20) using (customer_id)"""
)
def important_customers(spark, sf_dir):
    return joins.important_customers(customers(spark, sf_dir), transactions(spark, sf_dir))


@query(
    CT_SQL
    + """
select transaction_id, customer_id from transactions
where customer_id not in (select customer_id from customers where email is not null)"""
)
def orphan_transactions(spark, sf_dir):
    kept = cleaning.clean_customers(customers(spark, sf_dir))
    return joins.orphans(transactions(spark, sf_dir), kept, "customer_id").select("transaction_id", "customer_id")


@query(
    CTP_SQL
    + """
select product_id, product_name, p.category as category, price, count(*) as times_in_transactions,
       round(sum(amount), 2) as revenue_attributed, round(sum(amount) / count(*), 4) as revenue_per_transaction
from transactions t join products p on t.category = p.category
group by product_id, product_name, p.category, price"""
)
def product_performance(spark, sf_dir):
    found = joins.product_performance(transactions(spark, sf_dir), products(spark, sf_dir))
    return found.select(
        "product_id", "product_name", "category", "price", "times_in_transactions", rounded("revenue_attributed", 2),
        rounded("revenue_per_transaction"),
    )


@query(C_SQL + "select region, count(*) as count from customers group by region")
def repartition_preserves(spark, sf_dir):
    """As many partitions as the session's setting, then half of them."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = customers(spark, sf_dir).repartition(tasks, "region", "customer_id").coalesce(max(1, tasks // 2))
    return spread.groupBy("region").agg(F.count(F.lit(1)).alias("count"))
