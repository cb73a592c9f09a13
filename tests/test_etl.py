"""Cleaning, enrichment, insights, sources and sinks on small literal tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from custlytics.functions import fixed_values as fixed, labels
from custlytics.operators import cleaning, customer
from custlytics.session import create_spark_session
from custlytics.sources import readers, writers


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_session_is_reused(spark):
    assert create_spark_session("other").sparkContext is spark.sparkContext


def test_clean_customers(spark):
    df = spark.createDataFrame(
        [
            (17, "ines@mail.test", 24, "north"),
            (4, "odo@mail.test", 25, None),
            (4, "odo@mail.test", 25, None),
            (9, "per@mail.test", 64, "south"),
            (31, "uwe@mail.test", 65, "south"),
            (28, "zoe@mail.test", None, "north"),
            (12, None, 51, "north"),
            (None, "nobody@mail.test", 33, "south"),
        ],
        "customer_id int, email string, age int, area string",
    )
    found = cleaning.clean_customers(df, validator=lambda d: d.filter("customer_id <> 9"))
    assert found.columns == ["customer_id", "email", "age", "area", "age_group"]
    assert rows(found.select("customer_id", "age_group"), "customer_id") == [(4, "Adult"), (17, "Young"), (28, "Senior"), (31, "Senior")]
    assert cleaning.clean_customers(df).count() == 5


def test_clean_customers_keeps_the_first_by_order(spark):
    visits = [(7, "g@mail.test", 64, 3), (7, "g@mail.test", 66, 1), (7, None, 19, 2), (5, "e@mail.test", 24, 9), (6, None, 30, 1), (6, "f@mail.test", 31, 2)]
    df = spark.createDataFrame(visits, "customer_id int, email string, age int, visit int")
    found = cleaning.clean_customers(df, first_by=[F.col("visit").desc()])
    # Of customer 6 the last visit counts; an address missing there would drop the customer.
    assert rows(found.select("customer_id", "age", "age_group"), "customer_id") == [(5, 24, "Young"), (6, 31, "Adult"), (7, 64, "Adult")]
    assert [r.customer_id for r in cleaning.clean_customers(df, first_by=[F.col("visit")]).orderBy("customer_id").collect()] == [5, 7]


@pytest.mark.parametrize(
    ("amounts", "tier"),
    [
        ([10000.01], "Premium"), ([6000.0, 4000.0], "Gold"), ([5000.0, 0.25], "Gold"), ([5000.0], "Silver"), ([999.0, 2.0], "Silver"),
        ([1000.0], "Bronze"), ([-3.0], "Bronze"), ([None], "Bronze"), ([], "Bronze"),
    ],
)
def test_enrich_customers(spark, amounts, tier):
    customers = spark.createDataFrame([(81, "x"), (82, "y")], "customer_id int, note string")
    bought = [(n, 81, amount) for n, amount in enumerate(amounts)] + [(50, 99, 1e6)]
    found = customer.enrich_customers(customers, spark.createDataFrame(bought, "transaction_id int, customer_id int, amount double"))
    known = [a for a in amounts if a is not None]
    total = sum(known) if known else None
    mean = total / len(known) if known else None
    assert rows(found.drop("note"), "customer_id") == [(81, len(amounts) or None, total, mean, tier), (82, None, None, None, "Bronze")]


def test_customer_insights(spark):
    groups = {("Adult", "Gold"): [(40.0, 6000.0), (60.0, 7000.5)], ("Adult", None): [(1.0, None)], ("Young", "Bronze"): [(None, 5.0), (8.0, None), (9.0, 2.5)]}
    people = [(f"{g}{t}{n}", g, t, spent, total) for (g, t), each in groups.items() for n, (spent, total) in enumerate(each)]
    df = spark.createDataFrame(people, "customer_id string, age_group string, customer_tier string, total_spent double, total_transaction_amount double")
    assert sorted(rows(customer.customer_insights(df)), key=str) == [
        ("Adult", "Gold", 2, 50.0, 13000.5), ("Adult", None, 1, 1.0, None), ("Young", "Bronze", 3, 8.5, 7.5),
    ]


def test_customer_csv(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text(
        "customer_id,name,age,email,registration_date,total_spent\n"
        "k-3,Ada,61,ada@mail.test,2021-11-30,17.25\n"
        "k-1,\"Lee, Bo\",young,bo@mail.test,2022-07-01,3\n"
        "k-2,Cy,44,,2020-02-29,\n"
    )
    found = readers.read_customers(spark, str(path))
    assert found.schema == readers.CUSTOMER_FILE_SCHEMA
    assert [(r.customer_id, r.name, r.age, r.email, r.total_spent) for r in found.orderBy("customer_id").collect()] == [
        ("k-1", "Lee, Bo", None, "bo@mail.test", 3.0), ("k-2", "Cy", 44, None, None), ("k-3", "Ada", 61, "ada@mail.test", 17.25),
    ]


@pytest.mark.parametrize("layout", ["array", "lines"])
def test_transaction_json(spark, tmp_path, layout):
    records = [
        {"transaction_id": "T1", "amount": 5.5, "details": {"merchant": "m", "category": "c"}},
        {"transaction_id": "T2", "amount": 7.0, "items": [{"product": "p", "quantity": 2}]},
    ]
    path = tmp_path / "transactions.json"
    path.write_text(json.dumps(records, indent=1) if layout == "array" else "\n".join(map(json.dumps, records)))
    found = readers.read_transactions(spark, str(path), multi_line=layout == "array")
    assert rows(found.select("transaction_id", "details.merchant", "items.quantity"), "transaction_id") == [
        ("T1", "m", None), ("T2", None, [2]),
    ]


@pytest.mark.parametrize("format_type", ["parquet", "csv", "json", "PARQUET"])
def test_save_results(spark, tmp_path, format_type):
    df = spark.createDataFrame([(i, f"n{i}", "d") for i in range(4)], "id int, name string, department string")
    path = str(tmp_path / "out")
    writers.save_results(df.limit(1), path, format_type)
    writers.save_results(df, path, format_type, num_files=1)
    reader = spark.read.option("header", True).schema(df.schema)
    back = reader.format(format_type.lower()).load(path)
    assert rows(back, "id") == rows(df, "id")
    assert len(list((tmp_path / "out").glob("part-*"))) == 1
    writers.save_results(df, path, format_type, mode="append")
    assert reader.format(format_type.lower()).load(path).count() == 8


def test_save_results_rejects_other_formats(spark, tmp_path):
    with pytest.raises(ValueError, match="Unsupported format: xml"):
        writers.save_results(spark.range(1), str(tmp_path / "out"), "xml")


def test_bucketed_tables_join_without_shuffle(spark):
    left = spark.range(1000).selectExpr("id", "id * 2 as x")
    writers.save_bucketed(left, "bucketed_left", "id", 4)
    writers.save_bucketed(left, "bucketed_right", "id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed_left").join(spark.table("bucketed_right"), "id")
        assert joined.count() == 1000
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table bucketed_left")
        spark.sql("drop table bucketed_right")


def test_threshold_edges(spark):
    df = spark.createDataFrame(
        [(v,) for v in (None, 24, 25, 44, 45, 64, 65)], "age int"
    ).select("age", labels.age_group(F.col("age"), fixed.AGE_GROUPS_FOUR).alias("g"))
    assert [r.g for r in df.collect()] == ["Senior", "Young", "Adult", "Adult", "Middle-aged", "Middle-aged", "Senior"]
    cut = spark.createDataFrame([(v,) for v in (None, 0, 1, 580, 581, 850, 851)], "s int").select(
        labels.cut(F.col("s"), fixed.CREDIT_BIN_EDGES, fixed.CREDIT_BIN_LABELS).alias("c")
    )
    assert [r.c for r in cut.collect()] == [None, None, "Poor", "Poor", "Fair", "Excellent", None]


def test_rfm_edges(spark):
    data = [(1, "2024-08-01", 500.0)] + [(2, "2024-06-20", 250.0)] * 20 + [(3, "2023-01-01", 499.0)]
    df = spark.createDataFrame(data, "customer_id int, d string, amount double").withColumn(
        "transaction_date", F.to_date("d")
    )
    assert rows(customer.rfm(df).select("customer_id", "recency", "rfm_score"), "customer_id") == [
        (1, 19, "512"), (2, 61, "355"), (3, 597, "111"),
    ]


def test_amount_lists_are_split_and_whole(spark):
    df = spark.createDataFrame(
        [(i % 2, f"2024-01-{1 + i % 28:02d}", i, float(i)) for i in range(50)],
        "customer_id int, d string, transaction_id int, amount double",
    ).withColumn("transaction_date", F.to_date("d"))
    whole = {r.customer_id: r.amounts for r in customer.amount_lists(df).collect()}
    parts = rows(customer.amount_lists(df, list_rows=4), "customer_id", "part")
    for key in (0, 1):
        assert len(whole[key]) == 25
        assert sum([amounts for c, _, amounts in parts if c == key], []) == whole[key]
    assert max(len(amounts) for _, _, amounts in parts) == 4


def test_imputation(spark):
    df = spark.createDataFrame([(1, 2.0, 3), (2, None, 4), (3, 4.0, None), (4, 9.0, 4)], "id int, x double, n int")
    assert rows(cleaning.impute(df, ["x", "n"]), "id")[1:3] == [(2, 5.0, 4.0), (3, 4.0, pytest.approx(11 / 3))]
    assert rows(cleaning.impute(df, ["x", "n"], "median"), "id")[1:3] == [(2, 4.0, 4.0), (3, 4.0, 4.0)]
    with pytest.raises(ValueError):
        cleaning.impute(df, ["x"], "mode")


def test_constant_column_has_no_zscore(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, x double")
    assert rows(customer.zscore(df, ["x"]).select("x_zscore")) == [(None,), (None,)]
