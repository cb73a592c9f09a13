"""Queries on sources and sinks: tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from custlytics import etl
from custlytics.operators.ordered import large_groups
from custlytics.plans.registry import query, rounded
from custlytics.session import scratch_path, scratch_table
from custlytics.sources import json_arrays, readers, writers
from custlytics.sources.tables import C_SQL, CT_SQL, T_SQL, customers, table, transactions

#: Most transactions in one JSON array.
ARRAY_ROWS = 20_000


@query(
    C_SQL
    + """
select cast(customer_id as varchar) as customer_id, name, case when age < 60 then age end as age, email,
       cast(registration_date as varchar) as registration_date, total_spent from customers"""
)
def csv_roundtrip(spark, sf_dir):
    """Missing e-mail addresses come back as nulls, ages that are no numbers too."""
    people = customers(spark, sf_dir)
    age = F.when(F.col("age") < 60, F.col("age").cast("string")).otherwise("unknown")
    path = scratch_path(spark, "customers-csv")
    writers.save_results(
        people.select("customer_id", "name", age.alias("age"), "email", "registration_date", "total_spent"), path, "csv"
    )
    return readers.read_customers(spark, path)


@query(
    T_SQL
    + """
select transaction_id, customer_id, amount, merchant, category,
       '1-' || category || ' ' || transaction_id % 3 || '-' || merchant as items from transactions"""
)
def json_roundtrip(spark, sf_dir):
    """Nested values survive; the schema is inferred."""

    def item(quantity, product):
        return F.struct(quantity.alias("quantity"), F.col(product).alias("product"))

    items = F.array(item(F.lit(1).cast("bigint"), "category"), item(F.col("transaction_id") % 3, "merchant"))
    nested = transactions(spark, sf_dir).select(
        "transaction_id", "customer_id", "amount", F.struct("merchant", "category").alias("details"), items.alias("items")
    )
    path = scratch_path(spark, "transactions-json")
    writers.save_results(nested, path, "JSON")
    found = readers.read_transactions(spark, path, multi_line=False)
    written = F.transform("items", lambda i: F.concat_ws("-", i["quantity"].cast("string"), i["product"]))
    return found.select(
        "transaction_id", "customer_id", "amount", "details.merchant", "details.category",
        F.array_join(written, " ").alias("items"),
    )


@query("select * replace (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate) from orders")
def sink_parquet(spark, sf_dir):
    path = scratch_path(spark, "orders-parquet")
    writers.save_results(table(spark, sf_dir, "orders"), path)
    return spark.read.parquet(path).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query(T_SQL + "select transaction_id, customer_id, amount, merchant, category from transactions")
def json_multiline(spark, sf_dir):
    """Indented arrays of transactions, each in a file of its own: one per category and day of the month, more
    where these have over ``ARRAY_ROWS`` rows.

    Large groups are dealt out by a hash of their rows and numbered in each share, so that no array, and no
    task that reads one, holds more rows, whatever the table."""
    columns = ["transaction_id", "customer_id", "amount", "merchant", "category"]
    group = ["category", "day"]
    rows = transactions(spark, sf_dir).select(*columns, F.dayofmonth("transaction_date").alias("day"))
    large = large_groups(rows, group, ARRAY_ROWS)
    in_large = (F.col("category").eqNullSafe(F.col("_key_category"))) & (F.col("day").eqNullSafe(F.col("_key_day")))
    share = F.pmod(F.xxhash64(*columns), F.ceil(F.col("_rows") / ARRAY_ROWS))
    dealt = rows.join(F.broadcast(large), in_large, "left").withColumn("_share", F.coalesce(share, F.lit(0)))
    number = F.row_number().over(Window.partitionBy(*group, "_share").orderBy(*columns))
    row = F.struct("transaction_id", "customer_id", "amount", F.struct("merchant", "category").alias("details"))
    arrays = dealt.withColumn("_array", F.floor((number - 1) / ARRAY_ROWS)).groupBy(*group, "_share", "_array").agg(
        F.to_json(F.collect_list(row), {"pretty": "true"}).alias("value")
    )
    path = scratch_path(spark, "transactions-arrays")
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    found = readers.read_transactions(spark, path, multi_line=True)
    return found.select("transaction_id", "customer_id", "amount", "details.merchant", "details.category")


#: Most transactions in one JSON file.
FILE_ROWS = 1_000_000


@query(T_SQL + "select transaction_id, customer_id, amount, merchant, category from transactions")
def json_array_parts(spark, sf_dir):
    """One indented array of all transactions (one more for each ``FILE_ROWS``), read by as many tasks as the file has
    splits. Merchants carry quotes, brackets and braces, so that no text can be mistaken for the array's own."""
    odd = F.concat(F.lit('}],{"a":[{\\"} '), F.col("merchant"))
    row = F.struct("transaction_id", "customer_id", "amount", F.struct(odd.alias("merchant"), "category").alias("details"))
    rows = transactions(spark, sf_dir).select("transaction_id", F.to_json(row, {"pretty": "true"}).alias("json"))
    n_files = F.greatest(F.ceil(rows.agg((F.count(F.lit(1)) / FILE_ROWS).alias("n")).scalar()), F.lit(1))
    dealt = rows.withColumn("file", F.pmod(F.xxhash64("transaction_id"), n_files))
    in_file = Window.partitionBy("file").orderBy("transaction_id")
    first, last = F.row_number().over(in_file) == 1, F.lead("transaction_id").over(in_file).isNull()
    text = F.concat(F.when(first, "[\n").otherwise(",\n"), F.col("json"), F.when(last, "\n]").otherwise(""))
    path = scratch_path(spark, "transactions-array")
    dealt.select("file", "transaction_id", text.alias("value")).sortWithinPartitions("file", "transaction_id").select("file", "value").write.partitionBy("file").text(path)
    schema = "transaction_id bigint, customer_id bigint, amount double, details struct<merchant:string,category:string>"
    found = json_arrays.read_json_array(spark, path, schema)
    merchant = F.substring("details.merchant", 15, 1000).alias("merchant")
    return found.select("transaction_id", "customer_id", "amount", merchant, "details.category")


@query("select o_orderkey, count(*) as copies from (select o_orderkey from orders union all select o_orderkey from orders) group by all")
def append_parquet(spark, sf_dir):
    """A second write adds to the first."""
    path, orders = scratch_path(spark, "orders-twice"), table(spark, sf_dir, "orders")
    for _ in range(2):
        writers.save_results(orders, path, mode="append")
    return spark.read.parquet(path).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("copies"))


@query(
    """
with days as (select cast(ts as date) as day, value from events)
select cast(day as varchar) as day, count(*) as events,
       round(sum(case when day = (select min(day) from days) then 2 * value + 1 else value end), 4) as total
from days group by day"""
)
def replace_day(spark, sf_dir):
    """A second run of one day replaces that day only."""
    path = scratch_path(spark, "events-by-day")
    events = table(spark, sf_dir, "events").select("event_id", "value", F.col("ts").cast("date").alias("day"))
    writers.replace_partitions(events, path, ["day"])
    again = events.filter(F.col("day") == events.agg(F.min("day")).scalar()).withColumn("value", 2 * F.col("value") + 1)
    writers.replace_partitions(again, path, ["day"])
    found = spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"))
    return found.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))


@query(
    CT_SQL
    + """
select customer_id, region, count(*) as purchases, round(sum(amount), 2) as spent
from customers join transactions using (customer_id) group by all"""
)
def bucketed_join(spark, sf_dir):
    """Two tables bucketed by customer meet, and are summed up, without a shuffle."""
    tables = {}
    for name, rows in (("people", customers(spark, sf_dir).select("customer_id", "region")), ("purchases", transactions(spark, sf_dir).select("customer_id", "amount"))):
        tables[name], path = scratch_table(spark, name)
        writers.save_bucketed(rows, tables[name], "customer_id", 16, path=path)
    people, purchases = (spark.table(t) for t in tables.values())
    joined = people.join(purchases.hint("merge"), "customer_id")
    return joined.groupBy("customer_id", "region").agg(F.count(F.lit(1)).alias("purchases"), F.round(F.sum("amount"), 2).alias("spent"))


@query("select o_custkey, o_orderstatus, count(*) as orders from orders group by all")
def catalog_table(spark, sf_dir):
    """A saved table, read by its name. The name is new for each run; the files lie in the shared folder."""
    name, path = scratch_table(spark, "orders_table")
    table(spark, sf_dir, "orders").write.option("path", path).saveAsTable(name)
    return readers.read_table(spark, name).groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))


@query("select o_orderpriority, count(*) as orders, round(sum(o_totalprice), 2) as total from orders group by o_orderpriority")
def sql_entry(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders_view")
    return spark.sql(
        "select o_orderpriority, count(*) as orders, round(sum(o_totalprice), 2) as total "
        "from orders_view group by o_orderpriority"
    )


@query("select o_custkey, o_orderstatus, count(*) as orders from orders group by all")
def table_entry(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders_table")
    named = readers.read_table(spark, "orders_table")
    return named.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("orders"))


MAIL = r"([A-Za-z0-9._]+)@([A-Za-z0-9.]+)"


@query(
    rf"""
with lines as (select unnest(string_split(text, chr(10))) as line from documents)
select regexp_extract(line, '{MAIL}', 1) as mailbox, regexp_extract(line, '{MAIL}', 2) as host, count(*) as lines
from lines where regexp_matches(line, '{MAIL}') group by all"""
)
def log_extract(spark, sf_dir):
    """Mail addresses in the lines of all documents, scanned as text files."""
    path = scratch_path(spark, "documents-text")
    table(spark, sf_dir, "documents").select("text").write.text(path)
    found = readers.read_log(spark, path, MAIL, ["mailbox", "host"])
    return found.groupBy("mailbox", "host").agg(F.count(F.lit(1)).alias("lines"))


@query(
    CT_SQL
    + """,
grouped as (
  select *, case when age < 25 then 'Young' when age < 65 then 'Adult' else 'Senior' end as age_group
  from customers where email is not null),
metrics as (select customer_id, sum(amount) as total from transactions group by customer_id)
select age_group, case when total > 10000 then 'Premium' when total > 5000 then 'Gold' when total > 1000 then 'Silver'
                       else 'Bronze' end as customer_tier,
       count(*) as customer_count, round(avg(total_spent), 7) as avg_spending, round(sum(total), 4) as total_revenue
from grouped left join metrics using (customer_id) group by all"""
)
def customer_etl(spark, sf_dir):
    """The whole job on CSV customers and JSON transactions."""
    names = [field.name for field in readers.CUSTOMER_FILE_SCHEMA]
    folder = scratch_path(spark, "customer-etl")
    writers.save_results(customers(spark, sf_dir).select(*names), f"{folder}/customers", "csv")
    bought = transactions(spark, sf_dir).withColumn("customer_id", F.col("customer_id").cast("string"))
    writers.save_results(bought, f"{folder}/transactions", "json")
    insights = etl.run(spark, f"{folder}/customers", f"{folder}/transactions", folder, multi_line=False)
    return insights.select(
        "age_group", "customer_tier", "customer_count", rounded("avg_spending", 7), rounded("total_revenue")
    )
