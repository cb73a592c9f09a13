"""Table sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CUSTOMER_FILE_SCHEMA = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("email", T.StringType()),
        T.StructField("registration_date", T.StringType()),
        T.StructField("total_spent", T.DoubleType()),
    ]
)


def read_customers(spark: SparkSession, path: str, schema: T.StructType = CUSTOMER_FILE_SCHEMA) -> DataFrame:
    """CSV with a header line; empty fields and malformed numbers become null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_transactions(
    spark: SparkSession, path: str, schema: T.StructType | None = None, *, multi_line: bool = False
) -> DataFrame:
    """JSON lines, or with ``multi_line`` files of one array or object each.

    JSON lines can be split over tasks; a multi-line file is read by one task, whatever its size. Passing ``schema``
    saves the extra pass that infers one.
    """
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def extract_from_lines(lines: DataFrame, pattern: str, names: list[str], *, column: str = "value") -> DataFrame:
    """Keep the lines that match ``pattern`` and give its groups as columns, in order."""
    groups = [F.regexp_extract(column, pattern, i).alias(name) for i, name in enumerate(names, 1)]
    return lines.filter(F.col(column).rlike(pattern)).select(*groups)


def read_log(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Text files as one row per matching line."""
    return extract_from_lines(spark.read.option("lineSep", "\n").text(path), pattern, names)
