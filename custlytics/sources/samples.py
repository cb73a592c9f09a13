"""Random sample tables of any size, generated on the executors. The same seed gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Domains of the sample columns.
REGIONS = ("North", "South", "East", "West")
EDUCATION_LEVELS = ("High School", "Bachelor", "Master", "PhD")
MARITAL_STATUSES = ("Single", "Married", "Divorced", "Widowed")
TRANSACTION_CATEGORIES = ("Food", "Entertainment", "Shopping", "Travel", "Bills")
PRODUCT_CATEGORIES = ("Electronics", "Clothing", "Books", "Home", "Sports")


_SPAN = 2.0**53


class _Draw:
    """Independent random columns, each a hash of the row's id and a seed of its own: the same seed and id
    give the same value whatever the partitions."""

    def __init__(self, seed: int):
        self._seed = seed

    def unit(self) -> Column:
        self._seed += 1
        return F.shiftrightunsigned(F.xxhash64("id", F.lit(self._seed)), 11) / F.lit(_SPAN)

    def uniform(self, low: float, high: float) -> Column:
        return low + self.unit() * (high - low)

    def integer(self, low: int, high: int) -> Column:
        return F.floor(self.uniform(low, high + 1)).cast("bigint")

    def normal(self, mean: float, deviation: float) -> Column:
        radius = F.sqrt(-2 * F.log(1 - self.unit()))
        return mean + deviation * radius * F.cos(2 * math.pi * self.unit())

    def exponential(self, scale: float) -> Column:
        return -scale * F.log(1 - self.unit())

    def poisson(self, mean: float) -> Column:
        """How many of the distribution's steps lie below a uniform number; steps above 1 - 1e-9 are left out."""
        steps, term, reached = [], math.exp(-mean), 0.0
        while reached < 1 - 1e-9:
            reached += term
            steps.append(reached)
            term *= mean / len(steps)
        drawn = self.unit()
        return F.size(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s <= drawn)).cast("bigint")

    def choice(self, values: tuple) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), self.integer(1, len(values)).cast("int"))

    def day(self, first: str, days: int) -> Column:
        return F.date_add(F.lit(first).cast("date"), self.integer(0, days - 1).cast("int"))


def sample_customers(spark: SparkSession, rows: int = 10_000, seed: int = 42) -> DataFrame:
    """Income is missing for every 100th customer, the credit score for every 150th."""
    draw, key = _Draw(seed), F.col("id")
    return spark.range(1, rows + 1).select(
        key.alias("customer_id"),
        draw.normal(40, 15).cast("int").alias("age"),
        F.when(key % 100 != 0, draw.normal(60000, 20000)).alias("income"),
        F.when(key % 150 != 0, draw.normal(700, 100).cast("int")).alias("credit_score"),
        draw.exponential(5).alias("years_employed"),
        draw.choice(REGIONS).alias("region"),
        draw.choice(EDUCATION_LEVELS).alias("education"),
        draw.choice(MARITAL_STATUSES).alias("marital_status"),
        (draw.uniform(0, 1) < 0.5).alias("has_mortgage"),
        draw.poisson(4).alias("num_accounts"),
        draw.day("2023-01-01", 365).alias("registration_date"),
        draw.day("2024-01-01", 240).alias("last_login"),
    )


def sample_transactions(spark: SparkSession, rows: int = 50_000, customers: int = 10_000, seed: int = 142) -> DataFrame:
    draw = _Draw(seed)
    return spark.range(1, rows + 1).select(
        F.col("id").alias("transaction_id"),
        draw.integer(1, customers).alias("customer_id"),
        draw.day("2024-01-01", 240).alias("transaction_date"),
        F.exp(draw.normal(4, 1.5)).alias("amount"),
        draw.choice(TRANSACTION_CATEGORIES).alias("category"),
        F.concat(F.lit("Merchant_"), draw.integer(1, 1000).cast("string")).alias("merchant"),
        (draw.uniform(0, 1) < 0.5).alias("is_online"),
        (draw.uniform(0, 1) < 0.025).alias("is_fraud"),
    )


def sample_products(spark: SparkSession, rows: int = 1_000, seed: int = 242) -> DataFrame:
    draw = _Draw(seed)
    return spark.range(1, rows + 1).select(
        F.col("id").alias("product_id"),
        F.concat(F.lit("Product_"), F.col("id").cast("string")).alias("product_name"),
        draw.choice(PRODUCT_CATEGORIES).alias("category"),
        draw.uniform(10, 1000).alias("price"),
        F.round(draw.uniform(1, 5), 1).alias("rating"),
        draw.integer(0, 1000).alias("reviews_count"),
        (draw.uniform(0, 1) < 0.5).alias("in_stock"),
        draw.day("2020-01-01", 1826).alias("launch_date"),
    )


def sample_dataset(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers, transactions and products in their usual sizes."""
    return sample_customers(spark), sample_transactions(spark), sample_products(spark)
