"""Helpers shared by the corpus operators: Arrow batches, words and their hashes."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from custlytics.session import checkpointed

#: The characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
#: Documents in one Arrow batch: a batch of the longest documents still fits a small worker.
BATCH_ROWS = 256

BatchMap = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, function: BatchMap, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in batches of at most ``BATCH_ROWS`` rows, whatever the session allows.

    Sets the session's ``spark.sql.execution.arrow.maxRecordsPerBatch`` down to that number.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    allowed = int(df.sparkSession.conf.get(key, "10000"))
    if not 0 < allowed <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def gathered(batches: Iterable[pa.RecordBatch], column: str, least_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together until their texts have ``least_bytes``, for work on distinct strings."""
    held, size = [], 0
    for rows in batches:
        held.append(rows)
        size += pc.sum(pc.binary_length(rows.column(column))).as_py() or 0
        if size >= least_bytes:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def kept_in_worker(name: str, make: Callable):
    """What ``make`` gave in this Python worker the first time; workers outlive tasks."""
    kept = sys.__dict__.setdefault("_custlytics_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def released(spark: SparkSession) -> None:
    """The driver lets go of steps that nothing refers to any more: the files of their shuffles are deleted
    now and not at some later collection of garbage."""
    gc.collect()
    spark._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df``, after the steps before it are released."""
    released(df.sparkSession)
    return checkpointed(df)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: A random number for each byte, and an odd base, for hashes of words.
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
#: Longer words are hashed one by one: sums of powers of one base could collide for very long ones.
_LONG_WORD = 256


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all of them."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: the sum of its bytes' numbers times powers of a base, mixed with its
    length. All strings are hashed in one pass over their bytes."""
    words = words.cast(pa.large_string())
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    first, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[raw] * powers(_BASE, len(raw)))))
    sums = (upto[end] - upto[first]) * powers(pow(_BASE, -1, 2**64), len(raw) + 1)[first]
    hashes = mixed(sums ^ mixed((end - first).astype(np.uint64)))
    for k in np.flatnonzero(end - first > _LONG_WORD):
        hashes[k] = xxhash.xxh3_64_intdigest(raw[first[k] : end[k]].tobytes())
    return hashes


def word_codes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a column of texts (null: none).

    Returns the words as numbers of a dictionary, the place where each text's words start (with the
    end of the last one), and the dictionary.
    """
    texts = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    starts, values = split.offsets.to_numpy(), split.values
    encoded = values.dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    codes, words = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        real = codes != empty
        starts = np.concatenate(([0], np.cumsum(real)))[starts]
        codes = codes[real]
    return codes, starts.astype(np.int64), words
