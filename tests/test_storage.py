"""Tables that are written: partitions, buckets, metrics, sketches by day; and vectors of many labels."""

from __future__ import annotations

import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from custlytics import session
from custlytics.operators import features, quality, sketches
from custlytics.plans.registry import all_queries
from custlytics.sources import writers

SF = "/root/testdata/sf0.001"


def test_only_partitions_with_rows_are_replaced(spark, tmp_path):
    path = str(tmp_path / "days")
    writers.replace_partitions(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "v int, day string"), path, ["day"])
    writers.replace_partitions(spark.createDataFrame([(9, "a"), (8, "c")], "v int, day string"), path, ["day"])
    assert sorted((r.v, r.day) for r in spark.read.parquet(path).collect()) == [(3, "b"), (4, None), (8, "c"), (9, "a")]


def test_bucketed_join_has_no_shuffle(spark):
    plan = all_queries()["bucketed_join"].plan(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    plan += all_queries()["bucketed_join"].plan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_scratch_tables_are_dropped(spark, monkeypatch):
    monkeypatch.setattr(session, "_scratch", [])
    monkeypatch.setattr(session, "_tables", [])
    name, path = session.scratch_table(spark, "some_table")
    spark.range(3).write.option("path", path).saveAsTable(name)
    kept = session.stored(spark.range(5))
    assert spark.catalog.tableExists(name) and kept.count() == 5
    session.clear_scratch(spark)
    assert not spark.catalog.tableExists(name)


def test_stored_tables_can_be_forgotten(spark):
    kept = session.stored(spark.range(5).withColumn("x", F.lit(None).cast("string")))
    files = kept.inputFiles()
    assert kept.count() == 5 and files
    session.forget(kept)
    with pytest.raises(Exception):
        spark.read.parquet(files[0]).count()


def test_metrics_are_those_of_the_reports(spark, tmp_path):
    rows = [(1, 17, 5.0, 900), (2, 30, -1.0, None), (None, None, None, 299), (4, 101, 1.0, 300)]
    df = spark.createDataFrame(rows, "id int, age int, income double, credit_score int")
    found = writers.save_results(df, str(tmp_path / "out"), "json", observe=quality.checks(df.columns), num_files=2)
    assert {f"nulls_{r.column}": r.nulls for r in quality.null_profile(df).collect()}.items() <= found.items()
    assert {f"violations_{r.rule}": r.violations for r in quality.range_checks(df).collect()}.items() <= found.items()
    assert found["rows"] == 4 and writers.save_results(df, str(tmp_path / "plain")) == {}


def test_sketches_merge(spark):
    rows = [(f"2024-0{m}-0{d}", c, float(i), i % 7 if i else None) for m in (1, 2) for d in (1, 2) for c in ("a", None) for i in range(500)]
    df = spark.createDataFrame(rows, "transaction_date string, category string, amount double, customer_id int")
    daily = sketches.daily_sketches(df)
    assert daily.count() == 8
    merged = sketches.merged_sketches(sketches.merged_sketches(daily, ["category", F.month("day").alias("m")]), ["category"])
    out = merged.select("category", "rows", "n_values", "total", "least", "most", sketches.sketched_quantile(0.5).alias("q"), sketches.sketched_distinct().alias("n")).collect()
    for r in out:
        assert (r.rows, r.n_values, r.total, r.least, r.most, r.n) == (2000, 2000, 4 * sum(range(500)), 0.0, 499.0, 7) and abs(r.q - 250) < 15
    nothing = sketches.merged_sketches(sketches.daily_sketches(df.withColumn("amount", F.lit(None).cast("double"))), ["category"])
    assert {r.q for r in nothing.select(sketches.sketched_quantile(0.5).alias("q")).collect()} == {None}


def test_vectors_of_200_000_labels_hold_one_value(spark):
    df = spark.range(200_000).select(F.concat(F.lit("label "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("x"))
    encoded = features.one_hot(df, ["x"])
    sizes = encoded.select(features.sparse_parts(F.col("x_encoded")).alias("v")).agg(F.max(F.size("v.indices")), F.min("v.size"), F.max("v.size")).first()
    assert tuple(sizes) == (1, 199_999, 199_999)
    assert encoded.filter("x = 'label 000017'").first().x_encoded == SparseVector(199_999, {17: 1.0})


def test_vectors_of_few_labels(spark):
    df = spark.createDataFrame([("b", "k", None, 2), ("a", "k", None, 1), ("b", None, None, 2)], "x string, y string, z string, w int")
    rows = {(r.x, r.y): r for r in features.one_hot(df, ["x", "y", "z", "w"]).collect()}
    one, other = rows["b", "k"], rows["b", None]
    assert one.x_encoded == SparseVector(1, {0: 1.0}) and rows["a", "k"].x_encoded == SparseVector(1, {})
    assert one.y_encoded == SparseVector(0, {}) and other.y_encoded is None and other.y_indexed is None
    assert one.z_encoded is None and one.w_encoded == SparseVector(1, {0: 1.0})


def test_principal_axes(spark):
    rows = [(float(i % 7), float(i % 3) - i % 7, 5.0) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    axes = features.axis_errors(features.principal_axes(df, ["a", "b", "c"]), df, ["a", "b", "c"]).orderBy("component").collect()
    assert [r.component for r in axes] == [0, 1, 2] and all(r.error < 1e-9 for r in axes)
    assert axes[0].variance > axes[1].variance > abs(axes[2].variance) < 1e-9 and [abs(x) for x in axes[2].loadings] == [0.0, 0.0, 1.0]
    assert all(max(r.loadings) == max(map(abs, r.loadings)) for r in axes)
    one = features.principal_axes(df, ["a"]).first()
    assert one.loadings == [1.0]
