"""Joins and unions.

Adaptive execution broadcasts a side when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts, merges and splits skewed keys. A side is
broadcast by hint only through ``broadcast_if_small``, which measures it first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from custlytics.functions import fixed_values as fixed
from custlytics.operators.ordered import ordered_columns
from custlytics.session import checkpointed


MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def _row_bytes(df: DataFrame) -> Column:
    """About what a row takes: text and binary by their bytes, nested values as JSON, other values as eight bytes."""
    sizes = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            column = F.to_json(F.struct(column))
        elif not isinstance(field.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.lit(8))
            continue
        sizes.append(F.coalesce(F.octet_length(column), F.lit(0)) + 8)
    return reduce(lambda a, b: a + b, sizes)


def broadcast_if_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its rows have at most about ``max_bytes``.

    Worth it when the other side is huge. ``df`` is checkpointed: it is computed once and then measured."""
    df = checkpointed(df)
    size = df.agg(F.sum(_row_bytes(df))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def customer_transactions(customers: DataFrame, transactions: DataFrame) -> DataFrame:
    return customers.join(transactions, "customer_id")


def transaction_summary(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("amount").alias("total_spent"),
        F.avg("amount").alias("avg_transaction_amount"),
        F.max("transaction_date").alias("last_transaction_date"),
    )


def customers_with_summary(customers: DataFrame, transactions: DataFrame) -> DataFrame:
    """All customers; those without transactions get zeros and no last date."""
    summary = transaction_summary(transactions)
    joined = customers.join(summary, "customer_id", "left")
    return joined.fillna(0, ["transaction_count", "total_spent", "avg_transaction_amount"])


def closest_incomes(
    customers: DataFrame,
    limit: int = 20,
    max_gap: float = fixed.SIMILAR_INCOME_GAP,
    *,
    max_group_rows: int | None = None,
) -> DataFrame:
    """The ``limit`` closest pairs of customers of one region whose incomes differ by less than ``max_gap``.

    A pair counts in both directions; pairs are ordered by gap and then by the two customer ids (which
    must be unique). Within a region sorted by income and id, two customers more than ``limit`` places
    apart have at least ``limit`` pairs between them that come first, so each customer is compared with
    the next ``limit`` ones only. That is exact and linear, where a join on the region is quadratic.
    """
    known = customers.filter(F.col("income").isNotNull()).select("customer_id", "region", "income")
    ahead = ordered_columns(
        known.filter(F.col("region").isNotNull()),
        ["region"],
        ["income"],
        ties=["customer_id"],
        framed={
            "_next": lambda w: F.collect_list(F.struct("customer_id", "income")).over(w.rowsBetween(1, limit)),
        },
        after=limit,
        max_group_rows=max_group_rows,
    )
    pairs = ahead.select("customer_id", "region", "income", F.explode("_next").alias("other"))
    close = pairs.withColumn("gap", F.abs(F.col("income") - F.col("other.income"))).filter(F.col("gap") < max_gap)
    one, two = (F.col("customer_id"), F.col("income")), (F.col("other.customer_id"), F.col("other.income"))
    both_ways = F.array(
        *[
            F.struct(a[0].alias("customer1"), b[0].alias("customer2"), a[1].alias("income1"), b[1].alias("income2"))
            for a, b in ((one, two), (two, one))
        ]
    )
    return (
        close.select("region", "gap", F.explode(both_ways).alias("pair"))
        .select("region", "gap", "pair.*")
        .orderBy("gap", "customer1", "customer2")
        .limit(limit)
    )


def important_customers(
    customers: DataFrame,
    transactions: DataFrame,
    *,
    income: float = fixed.IMPORTANT_INCOME,
    transaction_count: int = fixed.FREQUENT_BUYER_TRANSACTIONS,
) -> DataFrame:
    """Customers with a high income or many transactions, each once."""
    rich = customers.filter(F.col("income") > income).select("customer_id", "region")
    busy = (
        transactions.groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > transaction_count)
        .join(customers, "customer_id")
        .select("customer_id", "region")
    )
    return rich.unionByName(busy).distinct()


def orphans(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Rows of ``child`` whose key is missing in ``parent``."""
    return child.join(parent.select(on), on, "left_anti")


def product_performance(transactions: DataFrame, products: DataFrame) -> DataFrame:
    """Transactions and revenue of each product's category, per product.

    Joining all transactions with all products of their category and then grouping by product gives
    every product the totals of its category; so the totals are formed first and joined to products.
    """
    per_category = transactions.groupBy("category").agg(
        F.count(F.lit(1)).alias("times_in_transactions"), F.sum("amount").alias("revenue_attributed")
    )
    return (
        products.select("product_id", "product_name", "category", "price")
        .join(per_category, "category")
        .withColumn("revenue_per_transaction", F.col("revenue_attributed") / F.col("times_in_transactions"))
    )
