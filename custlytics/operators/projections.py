"""Filters, string, regular-expression, date and nested-value projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from custlytics.functions import fixed_values as fixed, labels


def high_income(customers: DataFrame, above: float = fixed.HIGH_INCOME) -> DataFrame:
    wanted = customers.select("customer_id", "age", "income", "region").filter(F.col("income") > above)
    return wanted.orderBy(F.desc("income"), "customer_id")


def mortgage_holders(
    customers: DataFrame,
    *,
    ages: tuple[int, int] = (25, 45),
    educations: Sequence[str] = ("Bachelor", "Master"),
) -> DataFrame:
    return customers.filter(F.col("age").between(*ages) & F.col("education").isin(*educations) & F.col("has_mortgage"))


def parse_dates(df: DataFrame, columns: Sequence[str], *, strict: bool = False) -> DataFrame:
    """Text to dates; unreadable text becomes null unless ``strict``."""
    parse = F.to_date if strict else F.try_to_date
    return df.withColumns({c: parse(c, "yyyy-MM-dd") for c in columns})


def nulls_where_divisible(df: DataFrame, key: str, divisors: Mapping[str, int]) -> DataFrame:
    """Blank a column in every row whose key its divisor divides (for test data)."""
    return df.withColumns({c: F.when(F.col(key) % d != 0, F.col(c)) for c, d in divisors.items()})


def describe_in_text(customers: DataFrame) -> DataFrame:
    initial = [F.substring(c, 1, 1) for c in ("region", "education")]
    return customers.withColumns(
        {
            "region_upper": F.upper("region"),
            "education_length": F.length("education"),
            "initials": F.concat(initial[0], F.lit("-"), initial[1]),
            "customer_info": F.concat_ws(" | ", F.col("customer_id").cast("string"), "region", "education"),
        }
    )


def merchant_patterns(transactions: DataFrame) -> DataFrame:
    """Distinct merchants with number, size class and readable name, by number."""
    number = F.regexp_extract("merchant", fixed.MERCHANT_PATTERN, 1)
    size = labels.below(number.try_cast("int"), fixed.MERCHANT_SIZES, fixed.MERCHANT_SIZE_OTHER)
    return (
        transactions.select("merchant")
        .distinct()
        .select(
            "merchant",
            number.alias("merchant_number"),
            size.alias("merchant_category"),
            F.regexp_replace("merchant", "_", " ").alias("clean_merchant"),
        )
        .orderBy("merchant_number", "merchant")
    )


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """Occurrences of each lower-case word of the trimmed texts."""
    words = F.explode(F.split(F.lower(F.trim(F.coalesce(F.col(text), F.lit("")))), " "))
    return df.select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("occurrences"))


def interactions(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "debt_to_income_ratio": F.col("debt_ratio") * F.col("income"),
            "income_credit_interaction": F.col("income") * F.col("credit_score"),
            "age_income_interaction": F.col("age") * F.col("income"),
        }
    )


def log_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_log": F.log1p(c) for c in columns})


def binned(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "credit_score_category": labels.cut(
                F.col("credit_score"), fixed.CREDIT_BIN_EDGES, fixed.CREDIT_BIN_LABELS
            ),
            "age_group": labels.cut(F.col("age"), fixed.AGE_BIN_EDGES, fixed.AGE_BIN_LABELS),
        }
    )


def tagged(df: DataFrame, *, older_than: int = 30, tag: str = "processed") -> DataFrame:
    return df.filter(F.col("age") > older_than).withColumn("status", F.lit(tag))


def columns_of_type(df: DataFrame, *types: type[T.DataType]) -> DataFrame:
    return df.select(*[f.name for f in df.schema if isinstance(f.dataType, types)])
