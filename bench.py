"""Time the registered queries: ``BENCH_SF_DIR`` on ``local[BENCH_CPUS]``, one JSON line on stdout.

``BENCH_QUERIES`` (comma-separated) chooses other queries than the headline ones, ``all`` runs all.
Each query is run once to warm up; then the best of up to three runs counts, as in ``bench_rewrites.py``.
Its whole result is computed and thrown away. ``plan`` tells how much of that time went into making the
plan, with the jobs that some operators start for it.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from custlytics.plans.registry import all_queries
from custlytics.session import clear_scratch, create_spark_session

HEADLINE = [
    "customer_insights", "customer_ltv", "rfm", "cohort_months", "baskets", "customer_patterns", "amount_zscore",
    "fraud_features", "similar_income", "product_performance", "customer_tx_inner", "customer_summary_left",
    "important_customers", "orphan_transactions", "income_rank", "top_earners", "tx_sequence", "rolling_stats",
    "daily_moving_avg", "daily_cumulative", "global_stats", "category_stats", "pivot_spend", "region_multi_agg",
    "percentile_table", "describe_numeric", "null_profile", "corr_pairs", "iqr_cap", "impute_median",
    "standard_scale", "fitted_features", "anova_topk", "text_tokens", "extract_functions", "triage", "recipe_rank",
    "conversion_order", "strip_fence", "json_roundtrip", "income_rank_split", "rolling_stats_split",
    "percentile_table_split", "one_hot_wide", "category_stats_merged", "json_array_parts", "dependency_cycles",
]


RUNS, ENOUGH_SECONDS = 3, 6.0


def best(plan: Callable[[], DataFrame]) -> tuple[float, float]:
    """Seconds of the best run after a warm-up, and of its planning. Slow queries run less often."""

    def once() -> tuple[float, float]:
        start = time.perf_counter()
        df = plan()
        planned = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3), round(planned - start, 3)

    once()
    runs = [once()]
    while len(runs) < RUNS and sum(r[0] for r in runs) < ENOUGH_SECONDS:
        runs.append(once())
    return min(runs)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    known = all_queries()
    asked = os.environ.get("BENCH_QUERIES", "")
    names = list(known) if asked == "all" else asked.split(",") if asked else HEADLINE
    spark = create_spark_session(
        "bench",
        master=f"local[{cpus}]",
        settings={
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, planning = {}, {}
    for name in names:
        seconds[name], planning[name] = best(lambda: known[name].plan(spark, sf_dir))  # noqa: B023
        clear_scratch(spark)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "plan": planning, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
