"""Even shards from sampled splitters.

Records are ordered by a key that keeps equal texts together. A size-weighted sample of keys gives the
boundaries of many narrow ranges, ranges that turn out overfull are subdivided by further samples, and
the exact sizes of the ranges place every record in the global order, which is cut into equal shards.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from custlytics.llm.common import map_batches
from custlytics.session import checkpointed

LAWS = ("bytes", "rows")
#: Bytes that a record takes beside its text.
RECORD_BYTES = 16
#: Ranges for each shard, and sampled keys for each range. Their product with the number of shards
#: bounds what the driver holds.
RANGES_PER_SHARD, KEYS_PER_RANGE = 16, 16
#: A range with more than so many times the mean weight is subdivided.
OVERFULL = 2.0
_ROUNDS = 4
_HASH_SPAN = 2.0**64

_KEY = ["k1", "k2", "k3"]


def _records(docs: DataFrame) -> DataFrame:
    """Key, size and checksum of each record, without its text."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("k1"),
        F.coalesce("doc_id", F.lit(-(2**63))).alias("k2"),
        F.monotonically_increasing_id().alias("k3"),
    )


def _sample(records: DataFrame, share: dict[int, float], seed: int) -> list[tuple[int, tuple]]:
    """(range, key) of sampled records; a record of weight w is drawn with the probability w * share."""
    rates = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    drawn = (F.xxhash64(*_KEY, F.lit(seed)).cast("double") + _HASH_SPAN / 2) / _HASH_SPAN
    rows = records.filter(drawn < F.col("weight") * rates[F.col("range")]).select("range", *_KEY).collect()
    return sorted((r["range"], (r.k1, r.k2, r.k3)) for r in rows)


def _ranged(records: DataFrame, splitters: list[tuple]) -> DataFrame:
    """``records`` with the number of the range between the splitters that holds the key."""
    columns = [c for c in records.columns if c != "range"]
    schema = ", ".join(f"{c} bigint" for c in columns) + ", range int"

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys = zip(*(rows.column(c).to_pylist() for c in _KEY), strict=True)
            yield rows.append_column("range", pa.array([bisect_right(splitters, k) for k in keys], pa.int32()))

    return map_batches(records.select(*columns), assign, schema)


def _splitters(records: DataFrame, ranges: int, keys_per_range: int, seed: int) -> tuple[list[tuple], list]:
    """Boundaries of ranges of about even weight, and the exact (range, rows, bytes) between them."""
    splitters: list[tuple] = []
    sums = [F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum("weight").alias("weight")]
    totals = records.groupBy(F.lit(0).alias("range")).agg(*sums).collect()
    for attempt in range(_ROUNDS):
        total = sum(t.weight for t in totals)
        full = {t["range"]: t.weight for t in totals if t.weight > OVERFULL * total / ranges and t.n > 1}
        if not full:
            break
        # In each overfull range so many keys that its parts get the mean weight.
        at = _ranged(records, splitters)
        share = ranges * keys_per_range / total
        drawn = _sample(at, dict.fromkeys(full, float(share)), seed + attempt)
        for number, weight in full.items():
            keys = [key for of, key in drawn if of == number]
            parts = max(2, round(weight * ranges / total))
            splitters += [keys[len(keys) * i // parts] for i in range(1, parts) if keys]
        splitters = sorted(set(splitters))
        totals = _ranged(records, splitters).groupBy("range").agg(*sums).collect()
    return splitters, sorted((t["range"], t.n, t.bytes) for t in totals)


def shards(docs: DataFrame, n_shards: int = 40, law: str = "bytes", keys_per_range: int = KEYS_PER_RANGE, seed: int = 7) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``.

    ``bytes`` cuts the records' order into shards of near equal bytes (off by one record at most),
    ``rows`` into shards whose row counts differ by at most one. Equal texts lie side by side in that
    order, so a group of them is split only where a cut falls. ``size`` is the UTF-8 length of the text
    (null: none) plus 16, ``slot`` counts from 0 in each shard, ``grown_shard`` is null.

    Null ids and texts, repeated ids and equal rows are records like any other; an empty table gives no
    rows; other columns are not read. The driver holds at most
    ``n_shards * RANGES_PER_SHARD * keys_per_range`` sampled keys (about), and one row per range.
    """
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}")
    ranges = n_shards * RANGES_PER_SHARD
    # k3 depends on the partitions read: written once, every later pass sees the same keys.
    slim = checkpointed(_records(docs)).withColumn("weight", F.col("size") if law == "bytes" else F.lit(1).cast("bigint"))
    splitters, totals = _splitters(slim.withColumn("range", F.lit(0)), ranges, keys_per_range, seed)
    rows, size, before = 0, 0, []
    for number, n, in_range in totals:
        before.append((number, rows, size))
        rows, size = rows + n, size + in_range
    session = docs.sparkSession
    starts = session.createDataFrame(before, "range int, rows_before bigint, bytes_before bigint")
    within = Window.partitionBy("range").orderBy(*_KEY)
    placed = (
        _ranged(slim, splitters)
        .withColumn("rank", F.row_number().over(within).cast("bigint") - 1)
        .withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(starts), "range")  # a row per range
        .withColumn("rank", F.col("rank") + F.col("rows_before"))
        .withColumn("upto", F.col("upto") + F.col("bytes_before"))
    )
    if law == "bytes":
        place, span = 2 * F.col("upto") - F.col("size"), 2 * size  # the middle of the record
    else:
        place, span = F.col("rank"), rows
    exact = "decimal(30,0)"
    shard = F.floor(place.cast(exact) * n_shards / F.lit(max(span, 1)).cast(exact))
    placed = placed.withColumn("shard", F.least(shard, F.lit(n_shards - 1)).cast("int"))
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    return placed.join(F.broadcast(firsts), "shard").select(  # a row per shard
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard",
        (F.col("rank") - F.col("first_rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
