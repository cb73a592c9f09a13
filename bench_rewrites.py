"""Time the straightforward form of six operators against the form used here, in one session.

``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``; prints a Markdown table, best of up to four runs each.
"""

from __future__ import annotations

import os
import time
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window, functions as F

from custlytics.operators import customer, joins, quality, stats, windows
from custlytics.session import create_spark_session
from custlytics.sources import tables


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def best(action, patience: float = 10) -> float:
    """Best of up to four runs; no further run once one took longer than ``patience`` seconds."""
    times = []
    while len(times) < 4 and max(times, default=0) <= patience:
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return min(times)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = create_spark_session(
        "bench-rewrites",
        master=f"local[{cpus}]",
        settings={
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    people, bought, goods = (f(spark, sf_dir) for f in (tables.customers, tables.transactions, tables.products))

    def closest_by_self_join():
        other = people.select(*[F.col(c).alias(f"other_{c}") for c in ("customer_id", "region", "income")])
        near = (F.col("region") == F.col("other_region")) & (F.col("customer_id") != F.col("other_customer_id"))
        gap = F.abs(F.col("income") - F.col("other_income"))
        pairs = people.join(other, near & (gap < 5000)).select("customer_id", "other_customer_id", gap.alias("gap"))
        consume(pairs.orderBy("gap", "customer_id", "other_customer_id").limit(20))

    def products_by_full_join():
        joined = bought.join(goods, "category").groupBy("product_id", "product_name", "category", "price")
        consume(joined.agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("revenue")))

    def zscore_by_window():
        whole = Window.partitionBy()
        consume(bought.withColumn("z", (F.col("amount") - F.avg("amount").over(whole)) / F.stddev("amount").over(whole)))

    lines = people.select("customer_id", "income", "purchase_amount")
    spec = {"mean": ("income", "mean", 50), "total": ("purchase_amount", "sum", 30)}

    def nulls_by_column():
        for name in people.columns:
            people.filter(F.col(name).isNull()).count()
            people.count()

    measures = ["age", "income", "credit_score", "years_employed"]

    def correlations_by_pair():
        for a, b in combinations_with_replacement(measures, 2):
            people.agg(F.corr(a, b)).collect()

    cases = [
        ("closest incomes (J4)", closest_by_self_join, lambda: consume(joins.closest_incomes(people))),
        (
            "many-to-many join + aggregate (J7)",
            products_by_full_join,
            lambda: consume(joins.product_performance(bought, goods)),
        ),
        ("global z-score (W12)", zscore_by_window, lambda: consume(customer.zscore(bought, ["amount"]))),
        (
            "rolling statistics, one task / blocks of 2,000 (W13)",
            lambda: consume(windows.rolling(lines, "customer_id", spec)),
            lambda: consume(windows.rolling(lines, "customer_id", spec, max_group_rows=2000)),
        ),
        (
            "ranks by region, one task / blocks of 1,000 (W1-W3)",
            lambda: consume(windows.income_rank(lines.join(people.select("customer_id", "region"), "customer_id"))),
            lambda: consume(
                windows.income_rank(lines.join(people.select("customer_id", "region"), "customer_id"), max_group_rows=1000)
            ),
        ),
        ("null profile (Q1)", nulls_by_column, lambda: consume(quality.null_profile(people))),
        ("pairwise correlation (X1)", correlations_by_pair, lambda: consume(stats.corr_pairs(people, measures))),
    ]
    print("| operator (SURVEY id) | naive sec | rewrite sec | speed-up |\n| --- | --- | --- | --- |")
    for name, naive, rewrite in cases:
        slow, fast = best(naive), best(rewrite)
        print(f"| {name} | {slow:.2f} | {fast:.2f} | {slow / fast:.1f}x |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
