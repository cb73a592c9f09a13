"""Line de-duplication over sorted ranges of line hashes.

Every line becomes a row of two 64-bit hashes of its key, its document and its position. The rows are
range-partitioned by (hash, document, position), so that a key of any size is spread over as many
ranges as it needs, and streamed in that order. What comes back is one compressed bitmap of kept lines
per document that loses any; the texts do not move until the bitmaps are applied.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from custlytics.llm.common import batch, map_batches
from custlytics.session import checkpointed

LINES = "h1 bigint, h2 bigint, doc_id bigint, copy bigint, line int"
MARKS = f"kind int, {LINES}"
BITMAPS = "doc_id bigint, copy bigint, n_dropped bigint, keep binary"
KEPT = "doc_id bigint, n_lines bigint, n_dropped bigint, text string"

#: Kinds of a streamed row: dropped for sure, to be decided with the neighbour ranges, mark of a key
#: that is known to reach the threshold.
DROPPED, OPEN, REACHED = 0, 1, 2

_ORDER = ["h1", "h2", "doc_id", "copy", "line"]
_PA_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("copy", pa.int64()), ("line", pa.int32())])
_PA_MARKS = pa.schema([("kind", pa.int32()), *_PA_LINES])
_PA_BITMAPS = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())])
_PA_KEPT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())])


def copy_key() -> Column:
    """Tells rows of one doc_id with different texts apart; equal rows share their bitmap."""
    return F.xxhash64("text")


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # of bytes: exactly [\x20\x09-\x0D] and A-Z


def _line_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_128_digest
    for docs in batches:
        digests, counts, places = [], [], []
        for text in docs.column("text").to_pylist():
            keys = [line_key(line) for line in (text or "").encode().split(b"\n")]
            digests += [digest(k) for k in keys if k]
            place = [i for i, k in enumerate(keys) if k]
            places += place
            counts.append(len(place))
        hashes = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        of = np.repeat(np.arange(len(counts)), counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), docs.column("doc_id").take(pa.array(of)),
             docs.column("copy").take(pa.array(of)), pa.array(places, pa.int32())], schema=_PA_LINES,
        )


def _streamed(min_docs: int, keep_first: bool):
    """Streams one range in order; holds only the rows of the key at hand, and of those only until
    the key is known to reach the threshold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, last, held, edge, reached = None, 0, None, [], True, False

        def close(final: bool) -> list[tuple]:
            """Rows that are left when a key ends: those of a key cut by the range's edge stay open."""
            if key is None or not (edge or final):
                return []
            return [(OPEN, *r) for r in held] + ([(REACHED, *key, None, None, None)] if reached else [])

        for rows in batches:
            out = []
            for h1, h2, doc, copy, line in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if (h1, h2) != key:
                    out += close(False)
                    edge = key is None
                    key, docs, last, held, reached = (h1, h2), 0, (), [], False
                if doc != last or docs == 0:
                    docs, last = docs + 1, doc
                row = (h1, h2, doc, copy, line)
                if reached:
                    out.append((DROPPED, *row))
                    continue
                held.append(row)
                if docs >= min_docs:
                    reached = True
                    # The first line of all may lie in the range before.
                    out += [(DROPPED, *r) for r in held[keep_first:]]
                    held = held[:keep_first] if keep_first else []
            if out:
                yield batch(_PA_MARKS, *zip(*out, strict=True))
        if out := close(True):
            yield batch(_PA_MARKS, *zip(*out, strict=True))

    return run


def _bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        keeps = []
        for lines in rows.column("lines").to_pylist():
            keep = np.ones(max(lines) // 8 * 8 + 8, np.uint8)  # whole bytes
            keep[lines] = 0
            keeps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), rows.column("copy"), rows.column("n_dropped"), pa.array(keeps, pa.binary())],
            schema=_PA_BITMAPS,
        )


def line_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """One row (doc_id, copy, n_dropped, keep) per document that loses lines.

    A line's key is the line without blanks ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z in lower
    case. The lines of a key found in ``min_docs`` documents or more are dropped, with ``keep_first``
    all but the first one by (doc_id, position). ``keep`` is a zlib-packed bitmap, most significant bit
    first, up to the last dropped line; lines after it are kept.

    Null texts are empty; empty keys are never dropped. Rows of one doc_id (null is a doc_id too) count
    as one document; equal rows lose the same lines. An empty table gives no rows. Other columns are
    not read.
    """
    named = docs.select("doc_id", "text", copy_key().alias("copy"))
    lines = map_batches(named, _line_rows, LINES)
    ordered = lines.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    marks = checkpointed(map_batches(ordered, _streamed(min_docs, keep_first), MARKS))
    # Of each range only the first and the last key can stay open, with the lines of fewer than
    # ``min_docs`` documents: a few rows per range.
    cut = (
        marks.filter(F.col("kind") != DROPPED)
        .groupBy("h1", "h2")
        .agg(
            F.max(F.col("kind") == REACHED).alias("reached"),
            F.size(F.collect_set(F.when(F.col("kind") == OPEN, F.struct("doc_id")))).alias("docs"),
            F.sort_array(F.collect_list(F.when(F.col("kind") == OPEN, F.struct("doc_id", "copy", "line")))).alias("rows"),
        )
        .filter(F.col("reached") | (F.col("docs") >= min_docs))
        .select(F.explode(F.slice("rows", 2, F.size("rows")) if keep_first else "rows").alias("r"))
        .select("r.*")
    )
    dropped = marks.filter(F.col("kind") == DROPPED).select("doc_id", "copy", "line").unionByName(cut)
    # Equal rows of the table give each line several times.
    per_doc = dropped.groupBy("doc_id", "copy").agg(F.collect_set("line").alias("lines"))
    return map_batches(per_doc.withColumn("n_dropped", F.size("lines").cast("bigint")), _bitmaps, BITMAPS)


def kept_lines(keep: bytes, n_lines: int) -> np.ndarray:
    """Which of a document's lines are kept, from its bitmap."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n_lines].astype(bool)
    return np.concatenate([bits, np.ones(n_lines - len(bits), bool)])


def _applied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        n_lines, n_dropped, texts = [], [], []
        dropped = rows.column("n_dropped").to_pylist()
        for text, n, keep in zip(rows.column("text").to_pylist(), dropped, rows.column("keep").to_pylist(), strict=True):
            lines = (text or "").split("\n")
            n_lines.append(len(lines))
            n_dropped.append(n or 0)
            if keep is not None:
                lines = [line for line, kept in zip(lines, kept_lines(keep, len(lines)), strict=True) if kept]
            texts.append("\n".join(lines))
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts)],
            schema=_PA_KEPT,
        )


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the columns ``n_dropped`` and ``keep`` (null where nothing is dropped)."""
    found = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("copy").alias("_copy"), "n_dropped", "keep")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (copy_key() == F.col("_copy"))
    # The bitmaps are the side that is held in memory: the texts need no sort.
    return docs.join(found.hint("shuffle_hash"), same, "left").drop("_doc", "_copy")


def drop_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) with the lines of :func:`line_bitmaps` dropped, one row per row.

    ``n_lines`` counts the lines before; a null or empty text is one empty line.
    """
    slim = docs.select("doc_id", "text")
    return map_batches(with_bitmaps(slim, line_bitmaps(slim, min_docs, keep_first)), _applied, KEPT)


def dedup_documents(docs: DataFrame, min_docs: int = 10, keep_first: bool = True) -> DataFrame:
    """``docs`` with the dropped lines gone from ``text`` and ``n_chars``, where there is one, counted anew.

    With ``keep_first`` each frequent line stays where it occurs first. A document of which no word is left,
    as its lines stand in others, is dropped; one that loses nothing is returned as it is. All columns
    stay, whatever their names.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("rest"))
    joined = with_bitmaps(packed, line_bitmaps(packed, min_docs, keep_first))
    schema = packed.schema

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = []
            for text, keep in zip(rows.column("text").to_pylist(), rows.column("keep").to_pylist(), strict=True):
                if keep is not None:
                    lines = (text or "").split("\n")
                    lines = [line for line, kept in zip(lines, kept_lines(keep, len(lines)), strict=True) if kept]
                    text = "\n".join(lines)
                    text = text if text.encode().strip() else None
                texts.append(text)
            left = pa.array([t is not None or k is None for t, k in zip(texts, rows.column("keep").to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(texts, pa.string()), rows.column("rest")], names=["doc_id", "text", "rest"]
            ).filter(left)

    found = map_batches(joined.select("doc_id", "text", "rest", "keep"), cut, schema)
    columns = [F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in docs.columns]
    if "n_chars" in others:
        kind = docs.schema["n_chars"].dataType
        columns[docs.columns.index("n_chars")] = F.coalesce(F.char_length("text"), F.lit(0)).cast(kind).alias("n_chars")
    return found.select(*columns)
