"""The queries on ordered groups and quantiles once more, with every group of some size split over tasks.

They have the SQL of the plain queries: how a group is laid out must not show in the rows.
"""

from __future__ import annotations

from custlytics.operators.ordered import limited_groups
from custlytics.plans import aggregates, columns, customer, features, joins, quality, windows  # noqa: F401
from custlytics.plans.registry import query, registered
from custlytics.sources.tables import table

#: A group is split from so many rows on, or from this part of the customers.
LEAST_ROWS, PARTS = 20, 60

SPLIT = (
    "income_rank", "tx_sequence", "rank_first_last", "rolling_stats", "similar_income", "region_multi_agg",
    "group_summaries", "percentile_table", "iqr_cap", "qcut_income", "describe_numeric", "impute_median",
)


def _split(name: str):
    whole = registered(name)

    def plan(spark, sf_dir):
        rows = max(LEAST_ROWS, table(spark, sf_dir, "customer").count() // PARTS)
        with limited_groups(rows):
            return whole.plan(spark, sf_dir)

    plan.__name__ = f"{name}_split"
    return query(whole.oracle)(plan)


for _name in SPLIT:
    _split(_name)
