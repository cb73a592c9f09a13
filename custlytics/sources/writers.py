"""Table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation

FORMATS = ("parquet", "csv", "json")


def save_results(
    df: DataFrame, path: str, format_type: str = "parquet", *, mode: str = "overwrite", num_files: int | None = None,
    order: Sequence[str] = (), observe: Sequence[Column] = (),
) -> dict[str, object]:
    """Write ``df`` as parquet, CSV with a header, or JSON lines.

    Gives the values of the aggregates in ``observe`` (named columns, see :func:`custlytics.operators.quality.checks`)
    over the rows written, taken while they are written; without any, nothing.

    The writing tasks each produce a file. ``num_files`` shuffles to that many instead, so that a small
    file count does not slow down the stages before the write; ``order`` then sorts each file.
    """
    chosen = format_type.lower()
    if chosen not in FORMATS:
        raise ValueError(f"Unsupported format: {format_type}")
    observation = Observation()
    df = df.observe(observation, *observe) if observe else df
    df = df.repartition(num_files) if num_files else df
    writer = (df.sortWithinPartitions(*order) if order else df).write.mode(mode)
    if chosen == "csv":
        writer = writer.option("header", True)
    writer.format(chosen).save(path)
    return observation.get if observe else {}


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write ``df`` as parquet with a folder for each value of ``by``; folders that ``df`` has rows for are replaced,
    all others stay as they are.

    Rows of one folder are brought together, so that it gets few files; a folder of very many rows is
    written by several tasks."""
    dealt = df.hint("rebalance", *by)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, *, mode: str = "overwrite", path: str | None = None) -> None:
    """Save as a table bucketed and sorted by ``key``: later joins and groupings on it need no shuffle.

    Rows are brought to their buckets first, so that each bucket is one file. Without ``path`` the files lie in
    the warehouse."""
    writer = df.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def save_artifacts(artifacts: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Write artifact rows (``function_name``, ``file_name``, ``content``), one folder per kind of file.

    Files are ordered by function name, so reading one function touches few row groups. A folder per
    function would mean millions of tiny files.
    """
    ordered = artifacts.repartitionByRange("function_name", "file_name").sortWithinPartitions("file_name", "function_name")
    ordered.write.mode(mode).partitionBy("file_name").parquet(path)
