"""Every registered query against DuckDB, and the checks for those that SQL cannot state."""

from __future__ import annotations

import os

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from custlytics.operators import aggregates, cleaning, customer, features, joins, ordered, quality, stats
from custlytics.plans.registry import all_queries
from custlytics.session import settings_for
from custlytics.sources import samples, tables

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = all_queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.oracle))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name].plan(spark, SF_DIR)
    ok, note = compare(df, duck, QUERIES[name].oracle)
    assert ok, note
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in physical
    assert "NestedLoopJoin" not in physical


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) < set(entry_points.queries())


def test_approximate_quantiles_are_near_their_rank(spark):
    people = cleaning.impute(tables.customers(spark, SF_DIR), ["income"])
    values = [r.income for r in people.select("income").collect()]
    for error in (0.05, 0.01):
        for row in stats.approx_quantiles(people, "income", [0.25, 0.5, 0.75, 0.9], error).collect():
            below = sum(v < row.value for v in values) / len(values)
            upto = sum(v <= row.value for v in values) / len(values)
            assert below - error <= row.probability <= upto + error


def test_income_quintiles_have_even_sizes(spark):
    counts = QUERIES["income_quintile"].plan(spark, SF_DIR).groupBy("income_quintile").count().collect()
    total = sum(r["count"] for r in counts)
    assert sorted(r.income_quintile for r in counts) == [0, 1, 2, 3, 4]
    assert all(abs(r["count"] / total - 0.2) < 0.03 for r in counts)


def test_principal_components(spark):
    three = QUERIES["pca_features"].plan(spark, SF_DIR)
    assert three.select(F.min(F.size("pca_features")), F.max(F.size("pca_features"))).first() == (3, 3)
    kept = QUERIES["pca_95"].plan(spark, SF_DIR).select(F.col("pca_features").alias("p"))
    size = len(kept.first().p)
    columns = [F.col("p")[i] for i in range(size)]
    moments = kept.agg(*[F.avg(c) for c in columns], *[F.variance(c) for c in columns]).first()
    means, variances = moments[:size], moments[size:]
    assert means == pytest.approx([0] * size, abs=1e-9)
    assert list(variances) == sorted(variances, reverse=True)
    # Each of the seven standardised columns has variance 1.
    assert 0.95 * 7 <= sum(variances) <= 7
    assert sum(variances[:-1]) < 0.95 * 7


def test_chi_square_selection(spark):
    rows = [(float(i % 2), float(i % 3), float(i % 5), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "same double, three double, five double, label int")
    assert features.select_chi_square(df, ["same", "three", "five"], "label", 1) == ["same"]


def test_sample_tables_fit_the_operators(spark):
    people = samples.sample_customers(spark, 600)
    bought = samples.sample_transactions(spark, 3000, customers=600)
    assert people.filter("income is null").count() == 6 and people.filter("credit_score is null").count() == 4
    assert people.collect() == samples.sample_customers(spark, 600).collect()
    enriched = customer.enrich_customers(cleaning.with_profile_labels(people), bought)
    assert enriched.count() == 600
    assert {r.region for r in people.select("region").distinct().collect()} == set(samples.REGIONS)
    goods = samples.sample_products(spark, 100)
    assert joins.product_performance(bought, goods).count() == 0
    assert goods.filter("price between 10 and 1000 and rating between 1 and 5").count() == 100


def test_top_k_is_cut_before_the_shuffle(spark):
    for name in ("top_earners", "dedup_latest", "top_values"):
        physical = QUERIES[name].plan(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in physical


def test_filters_and_columns_reach_the_scan(spark):
    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
    wanted = customer.category_status(
        orders.select(F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("amount")), 1000
    )
    physical = wanted._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in physical
    assert "ReadSchema: struct<o_totalprice:double,o_orderpriority:string>" in physical


def test_correlation_leaves_null_pairs_out(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.1), (None, 9.0)], "a double, b double")
    found = {(r.feature1, r.feature2): r.correlation for r in stats.corr_pairs(df, ["a", "b"]).collect()}
    assert found["a", "b"] > 0.99 and found["a", "a"] == pytest.approx(1)


def test_quality_of_an_empty_table(spark):
    df = spark.createDataFrame([], "age int, income double, credit_score int")
    assert [tuple(r) for r in quality.null_profile(df).collect()] == [
        ("age", 0, None), ("income", 0, None), ("credit_score", 0, None),
    ]
    assert [r.violations for r in quality.range_checks(df).collect()] == [0, 0, 0]


def test_dummies_read_their_values(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert features.dummies(df, "x").columns == ["x", "x_a", "x_b"]
    assert len(features.dummies(spark.range(9).selectExpr("cast(id as string) x"), "x").columns) == 10


def test_json_arrays_are_bounded(spark, tmp_path):
    orders = spark.range(0, 50_000, numPartitions=4).selectExpr(
        "if(id < 25000, 7, id) as o_orderkey", "1L as o_custkey", "timestamp'1996-01-02' as o_orderdate",
        "500.0D as o_totalprice", "if(id < 49990, '1-URGENT', null) as o_orderpriority",
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["json_multiline"].plan(spark, str(tmp_path))
    sizes = [r["count"] for r in got.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 50_000 and len(sizes) > 3 and max(sizes) <= 20_000
    wanted = tables.transactions(spark, str(tmp_path)).select(got.columns)
    assert got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty()


def test_dummies_query_reads_no_values(spark, monkeypatch):
    given, made = [], features.dummies
    monkeypatch.setattr(features, "dummies", lambda df, column, values=None: given.append((column, values)) or made(df, column, values))
    QUERIES["one_hot_dummies"].plan(spark, SF_DIR)
    assert [column for column, values in given if values] == ["region", "marital_status"]


def test_top_values_and_duplicates(spark):
    df = spark.createDataFrame([("a", True), ("a", None), ("b", True), (None, False)], "x string, y boolean")
    top = aggregates.top_values(df, k=1).orderBy("column").collect()
    assert [(r.column, r.value, r["count"]) for r in top] == [("x", "a", 2), ("y", "true", 2)]
    assert aggregates.duplicate_keys(df, ["x"]).count() == 1


@pytest.fixture(scope="module")
def skewed_dir(tmp_path_factory, duck):
    """The tables with a third of all orders on one customer and day, and most customers in one region."""
    folder = tmp_path_factory.mktemp("skewed")
    changed = {
        "orders": "select * replace (case when o_orderkey % 3 = 0 then 7 else o_custkey end as o_custkey, "
        "case when o_orderkey % 3 = 0 then timestamp '1998-01-01' else o_orderdate end as o_orderdate) from orders",
        "customer": "select * replace (case when c_custkey % 5 > 0 then 1 else c_nationkey end as c_nationkey, "
        "case when c_custkey % 3 = 0 then 500.0 else c_acctbal end as c_acctbal) from customer",
    }
    for name in ("region", "nation", "customer", "orders", "part"):
        duck.execute(f"copy ({changed.get(name, f'select * from {name}')}) to '{folder}/{name}.parquet'")
    return str(folder)


@pytest.mark.parametrize(
    "name",
    [
        "tx_sequence", "amount_lists", "baskets", "category_arrays", "customer_patterns", "enrich_customers", "rfm",
        "income_rank", "top_earners", "similar_income", "rank_first_last", "dedup_latest", "cohort_months",
        "daily_cumulative", "impute_median", "qcut_income", "region_multi_agg", "orphan_transactions",
    ],
)
def test_skewed_tables(spark, skewed_dir, name):
    connection = connect(SF_DIR)
    for table in ("region", "nation", "customer", "orders", "part"):
        connection.execute(f"create or replace view {table} as select * from '{skewed_dir}/{table}.parquet'")
    ok, note = compare(QUERIES[name].plan(spark, skewed_dir), connection, QUERIES[name].oracle)
    assert ok, note


def test_any_number_of_labels(spark):
    df = spark.range(200_000).selectExpr("cast(id as string) as x").unionAll(spark.createDataFrame([("7",), (None,)], "x string"))
    indexed = features.string_index(df, ["x"])
    found = indexed.agg(F.count_distinct("x_indexed"), F.max("x_indexed"), F.count_if(F.col("x_indexed").isNull())).first()
    assert tuple(found) == (200_000, 199_999.0, 1)
    assert {r.x for r in indexed.filter("x_indexed = 0").select("x").collect()} == {"7"}


def test_broadcast_only_of_measured_small_tables(spark):
    small = joins.broadcast_if_small(spark.range(5), 100)
    large = joins.broadcast_if_small(spark.range(500), 100)
    plans = [df._jdf.queryExecution().analyzed().toString() for df in (small, large)]
    assert ["ResolvedHint" in plan for plan in plans] == [True, False]


@pytest.mark.parametrize("rows", [None, 1])
def test_groups_without_values_and_the_null_group_stay(spark, rows):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), ("a", None), ("n", None), ("n", None), (None, 5.0), (None, 7.0)], "g string, v double"
    )
    with ordered.limited_groups(rows or ordered.MAX_GROUP_ROWS):
        found = {r.g: (r["median"], r["count"]) for r in aggregates.group_summary(df, "g", "v").collect()}
    assert found == {"a": (2.0, 2), "n": (None, 0), None: (6.0, 2)}


def test_cohorts_count_a_customer_once(spark):
    customers = spark.createDataFrame(
        [(1, "2024-01-05"), (1, "2024-01-05"), (2, "2024-01-09")], "customer_id long, registration_date string"
    ).withColumn("registration_date", F.to_date("registration_date"))
    bought = spark.createDataFrame(
        [(1, "2024-02-01", 5.0), (1, "2024-02-02", 6.0), (2, "2024-02-03", 7.0)],
        "customer_id long, transaction_date string, amount double",
    ).withColumn("transaction_date", F.to_date("transaction_date"))
    row = customer.cohort_months(customers, bought).first()
    assert (row.active_customers, row.transactions, row.revenue) == (2, 3, 18.0)


def test_partition_settings_grow_with_the_input():
    assert settings_for(10**9)["spark.sql.shuffle.partitions"] == "200"
    assert int(settings_for(100 * 10**12)["spark.sql.shuffle.partitions"]) > 300_000


@pytest.mark.parametrize("error", [ImportError, ModuleNotFoundError])
def test_queries_without_the_optional_part(monkeypatch, error):
    """A package that the optional part needs and that is missing takes only that part away."""
    import builtins
    import importlib

    entry, made = importlib.import_module("__spark_entry__"), builtins.__import__

    def refuse(name, globals=None, locals=None, fromlist=(), level=0):
        if name == "custlytics.llm" or name.startswith("custlytics.llm."):
            raise error(name)
        return made(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", refuse)
    assert set(entry.queries()) == set(QUERIES) and not set(entry.oracle_sql()) - set(QUERIES)


def test_input_of_several_steps_is_read_once(spark):
    from custlytics import session

    session.release()
    df = QUERIES["fitted_features"].plan(spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan and len(session._reused) == 1
    session.release()
    assert not session._reused
