"""JSON files of one array, read by many tasks.

Spark reads a multi-line JSON file in one task. Here the file is read as text that ends at closing braces, which
Spark splits by bytes like any text, and three light passes make objects of the pieces:

1. Each split says where it ends (inside a string or not, brackets open or closed) for both ways that it may
   begin. Put together in the order of the splits this gives the place at which each one begins. The driver
   holds one entry per split, as it does of the splits themselves.
2. Each split gives the objects that lie wholly in it.
3. Objects that reach over the end of a split are joined of their parts, at most two per split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from custlytics.sources import json_pieces

_SUMMARY = "file string, block bigint, first string, inside0 boolean, depth0 bigint, inside1 boolean, depth1 bigint"
_RECORDS = "file string, block bigint, part int, opens boolean, value string"


def _starts(blocks: list) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """Where each block begins, and the depth between two objects of its file."""
    starts, file, place, between = {}, None, (False, 0), 0
    for row in sorted(blocks, key=lambda r: (r.file, r.block)):
        if row.file != file:
            file, place, between = row.file, (False, 0), int(row.first == "[")
        starts[row.file, row.block] = (*place, between)
        place = (row.inside1, place[1] + row.depth1) if place[0] else (row.inside0, place[1] + row.depth0)
    return starts


def read_json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(value): the text of every object of an array, or of objects one after another, in files below ``path``.

    Files are UTF-8. Elements of the array that are no objects are left out. Splits are those of
    ``spark.sql.files.maxPartitionBytes``; compressed files cannot be split."""
    text = spark.read.option("lineSep", "}").text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    starts = spark.sparkContext.broadcast(_starts(pieces.mapInArrow(json_pieces.summaries, _SUMMARY).collect()))
    whole = pieces.mapInArrow(json_pieces.records(starts, False), _RECORDS).select("value")
    parts = pieces.mapInArrow(json_pieces.records(starts, True), _RECORDS)
    so_far = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = parts.withColumn("number", F.sum(F.col("opens").cast("int")).over(so_far))
    in_order = F.array_sort(F.collect_list(F.struct("block", "part", "value")))
    joined = numbered.groupBy("file", "number").agg(F.array_join(F.transform(in_order, lambda p: p["value"]), "").alias("value"))
    return whole.unionByName(joined.select("value"))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The objects of JSON arrays as rows of ``schema``; objects that are not valid have nulls in all columns."""
    return read_json_objects(spark, path).select(F.from_json("value", schema).alias("row")).select("row.*")
