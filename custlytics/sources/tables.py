"""Customers, transactions and products as views of the star-schema parquet tables.

Column names and types follow the reference data model; attributes the star schema lacks are
computed from the keys, so every table grows with its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MARITAL_STATUSES = ("Single", "Married", "Divorced", "Widowed")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place + 1).cast("int"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    base = table(spark, sf_dir, "customer").join(regions, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    return base.select(
        key.alias("customer_id"),
        F.col("c_name").alias("name"),
        F.when(key % 50 != 0, F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")))
        .alias("email"),
        (18 + key * 13 % 70).cast("int").alias("age"),
        F.when(key % 100 != 0, 20000 + 10 * F.col("c_acctbal")).alias("income"),
        F.when(key % 150 != 0, (300 + key * 37 % 551).cast("int")).alias("credit_score"),
        ((key * 7 % 40).cast("double") / 2).alias("years_employed"),
        ((key * 31 % 1000).cast("double") / 1000).alias("debt_ratio"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("education"),
        _pick(MARITAL_STATUSES, key % 4).alias("marital_status"),
        (key % 2 == 0).alias("has_mortgage"),
        (key % 9).cast("int").alias("num_accounts"),
        F.date_add(F.lit("2020-01-01").cast("date"), (key * 17 % 1400).cast("int")).alias("registration_date"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key * 11 % 240).cast("int")).alias("last_login"),
        (10 + (key * 7919 % 100003).cast("double") / 100).alias("purchase_amount"),
        F.col("c_acctbal").alias("total_spent"),
    )


CUSTOMERS_SQL = """
customers as (
  select c_custkey as customer_id, c_name as name,
         case when c_custkey % 50 <> 0
              then lower(replace(c_name, '#', '.')) || '@example.com' end as email,
         cast(18 + c_custkey * 13 % 70 as integer) as age,
         case when c_custkey % 100 <> 0 then 20000 + 10 * c_acctbal end as income,
         case when c_custkey % 150 <> 0 then cast(300 + c_custkey * 37 % 551 as integer) end as credit_score,
         cast(c_custkey * 7 % 40 as double) / 2 as years_employed,
         cast(c_custkey * 31 % 1000 as double) / 1000 as debt_ratio,
         r_name as region, c_mktsegment as education,
         case c_custkey % 4 when 0 then 'Single' when 1 then 'Married' when 2 then 'Divorced'
              else 'Widowed' end as marital_status,
         c_custkey % 2 = 0 as has_mortgage,
         cast(c_custkey % 9 as integer) as num_accounts,
         date '2020-01-01' + cast(c_custkey * 17 % 1400 as integer) as registration_date,
         date '2024-01-01' + cast(c_custkey * 11 % 240 as integer) as last_login,
         10 + cast(c_custkey * 7919 % 100003 as double) / 100 as purchase_amount,
         c_acctbal as total_spent
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
)"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("transaction_date"),
        (F.col("o_totalprice") / 250).alias("amount"),
        F.col("o_orderpriority").alias("category"),
        F.concat(F.lit("Merchant_"), (key % 1000 + 1).cast("string")).alias("merchant"),
        (key % 2 == 0).alias("is_online"),
        (key % 40 == 0).alias("is_fraud"),
    )


TRANSACTIONS_SQL = """
transactions as (
  select o_orderkey as transaction_id, o_custkey as customer_id,
         cast(o_orderdate as date) as transaction_date, o_totalprice / 250 as amount,
         o_orderpriority as category, 'Merchant_' || cast(o_orderkey % 1000 + 1 as varchar) as merchant,
         o_orderkey % 2 = 0 as is_online, o_orderkey % 40 = 0 as is_fraud
  from orders
)"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("product_id"),
        F.col("p_name").alias("product_name"),
        _pick(PRIORITIES, key % 5).alias("category"),
        F.col("p_retailprice").alias("price"),
        (1 + (key * 7 % 41).cast("double") / 10).alias("rating"),
        (key * 13 % 1000).cast("int").alias("reviews_count"),
        (key % 3 != 0).alias("in_stock"),
        F.date_add(F.lit("2020-01-01").cast("date"), (key * 19 % 1800).cast("int")).alias("launch_date"),
    )


PRODUCTS_SQL = """
products as (
  select p_partkey as product_id, p_name as product_name,
         case p_partkey % 5 when 0 then '1-URGENT' when 1 then '2-HIGH' when 2 then '3-MEDIUM'
              when 3 then '4-NOT SPECIFIED' else '5-LOW' end as category,
         p_retailprice as price, 1 + cast(p_partkey * 7 % 41 as double) / 10 as rating,
         cast(p_partkey * 13 % 1000 as integer) as reviews_count, p_partkey % 3 <> 0 as in_stock,
         date '2020-01-01' + cast(p_partkey * 19 % 1800 as integer) as launch_date
  from part
)"""


def customer_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer records as delivered: overdrawn accounts were sent a second time, a year older."""
    first = customers(spark, sf_dir).withColumn("version", F.lit(1))
    again = first.filter(F.col("total_spent") < 0).withColumns({"version": F.lit(2), "age": F.col("age") + 1})
    return first.unionByName(again)


CUSTOMER_FEED_SQL = """
customer_feed as (
  select *, 1 as version from customers
  union all by name
  select * replace (age + 1 as age), 2 as version from customers where total_spent < 0
)"""


def with_sql(*parts: str) -> str:
    return "with " + ",".join(parts)


C_SQL = with_sql(CUSTOMERS_SQL)
T_SQL = with_sql(TRANSACTIONS_SQL)
CT_SQL = with_sql(CUSTOMERS_SQL, TRANSACTIONS_SQL)
CTP_SQL = with_sql(CUSTOMERS_SQL, TRANSACTIONS_SQL, PRODUCTS_SQL)
FEED_SQL = with_sql(CUSTOMERS_SQL, TRANSACTIONS_SQL, CUSTOMER_FEED_SQL)
