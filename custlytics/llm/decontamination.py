"""Benchmark passages in documents, found with an FM-index per shard of the documents.

A task gathers the documents of its partition in shards of a bounded number of words, indexes each shard
and searches all windows of the benchmark in it. Only runs of words that occur in the benchmark at all can
hold a window, so only these runs are indexed; the words between them become one separator.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from custlytics.llm.common import map_batches, word_codes
from custlytics.llm.fm_index import FmIndex
from custlytics.operators.joins import broadcast_if_small
from custlytics.session import stored

WINDOW = 13
#: Document words in one shard.
SHARD_WORDS = 2_000_000
#: Benchmark text that is sent to the tasks at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 8 << 20
#: Occurrences that are located at once.
LOCATED = 1_000_000

#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z in lower case; others
#: become blanks.
_WORD_BYTES = np.full(256, ord(" "), np.uint8)
_WORD_BYTES[128:] = np.arange(128, 256)
for _first, _last, _to in (("0", "9", "0"), ("a", "z", "a"), ("A", "Z", "a")):
    for _k in range(ord(_last) - ord(_first) + 1):
        _WORD_BYTES[ord(_first) + _k] = ord(_to) + _k
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_PA_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def plain_words(texts: pa.Array) -> pa.Array:
    """The texts with A-Z in lower case and a blank for every byte outside a word."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).copy()), pa.py_buffer(_WORD_BYTES[raw]))


@dataclass
class Phrases:
    """The windows of a block of benchmark items, as numbers of a vocabulary that starts at 1."""

    vocabulary: pa.Array
    windows: np.ndarray
    lengths: np.ndarray
    #: For each window the number of its set of items, and these sets.
    item_set: np.ndarray
    item_sets: list[list[str]]


def phrases(items: list[tuple], window: int = WINDOW) -> Phrases:
    """Windows of (item_id, text) rows; an item of fewer words, but not none, is one window."""
    codes, starts, words = word_codes(plain_words(pa.array([t for _, t in items], pa.string())))
    of: dict[tuple, set[str]] = {}
    for (name, _), a, b in zip(items, starts[:-1], starts[1:], strict=True):
        item = [int(c) + 1 for c in codes[a:b]]
        for k in range(max(1, len(item) - window + 1) if item else 0):
            of.setdefault(tuple(item[k : k + window]), set()).add("" if name is None else str(name))
    array = np.zeros((len(of), window), np.int64)
    lengths = np.array([len(w) for w in of], np.int64)
    for row, w in zip(array, of, strict=True):
        row[: len(w)] = w
    sets: dict[tuple, int] = {}
    item_set = np.array([sets.setdefault(tuple(sorted(names)), len(sets)) for names in of.values()], np.int64)
    return Phrases(words, array, lengths, item_set, [list(s) for s in sets])


def search_shard(texts: list[pa.Array], wanted: Phrases) -> list[tuple[int, list, list[str]]]:
    """(number of words, merged spans of hit words, items) for each text."""
    parts = [word_codes(plain_words(t)) for t in texts]
    sizes = np.concatenate([np.diff(starts) for _, starts, _ in parts])
    ids = []
    for codes, _, words in parts:
        known = pc.index_in(words, value_set=wanted.vocabulary.cast(words.type)) if len(words) else pa.array([], pa.int32())
        ids.append((pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1)[codes] if len(codes) else codes)
    ids = np.concatenate(ids).astype(np.int64)
    ends = np.cumsum(sizes)
    hits = np.zeros(len(ids) + 1, np.int64)
    items: dict[int, set[int]] = {}
    if len(wanted.lengths) and len(ids):
        sequence, places = _runs(ids, ends, int(wanted.lengths.min()))
        if len(sequence):
            index = FmIndex(sequence, len(wanted.vocabulary) + 1)
            low, high = index.search(wanted.windows, wanted.lengths)
            for which, rows in _blocks(low, high):
                start = places[index.locate(rows)]
                np.add.at(hits, start, 1)
                np.add.at(hits, start + wanted.lengths[which], -1)
                pairs = np.searchsorted(ends, start, "right") * len(wanted.item_sets) + wanted.item_set[which]
                for pair in np.unique(pairs).tolist():
                    items.setdefault(pair // len(wanted.item_sets), set()).add(pair % len(wanted.item_sets))
    covered = np.concatenate(([0], (np.cumsum(hits[:-1]) > 0).astype(np.int8), [0]))
    edges = np.diff(covered)
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out = []
    for k, (end, n) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
        if k not in items:
            out.append((n, [], []))
            continue
        begin = end - n
        a, b = np.searchsorted(last, begin, "right"), np.searchsorted(first, end, "left")
        spans = [[max(int(x), begin) - begin, min(int(y), end) - begin] for x, y in zip(first[a:b], last[a:b], strict=True)]
        out.append((n, spans, sorted({name for s in items[k] for name in wanted.item_sets[s]})))
    return out


def _runs(ids: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of at least ``least`` benchmark words inside one text, each followed by a separator (0), and
    the place of each of their words among ``ids``."""
    breaks = np.zeros(len(ids) + 1, bool)
    breaks[ends] = True
    breaks[0] = True
    known = ids > 0
    opens = known & (breaks[:-1] | ~np.concatenate(([False], known[:-1])))
    closes = known & (breaks[1:] | ~np.concatenate((known[1:], [False])))
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = last - first >= least
    first, n = first[long], (last - first)[long] + 1
    upto = np.cumsum(n)
    places = np.repeat(first - (upto - n), n) + np.arange(upto[-1] if len(n) else 0)
    sequence = ids[np.minimum(places, len(ids) - 1)]
    sequence[upto - 1] = 0
    return sequence, places


def _blocks(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, row) of all occurrences, a bounded number at a time."""
    counts = high - low
    upto = np.concatenate(([0], np.cumsum(counts)))
    for at in range(0, int(upto[-1]), LOCATED):
        k = np.arange(at, min(at + LOCATED, int(upto[-1])))
        which = np.searchsorted(upto, k, "right") - 1
        yield which, low[which] + k - upto[which]


def _blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark's (item_id, text), no more than about ``block_bytes`` of text at a time."""
    items = benchmark.select("item_id", "text").filter(F.length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield [(r.item_id, r.text) for r in rows]


def find_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, column: str = "found",
    shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with a struct ``column`` of (n_words, spans, items), one row per row.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case. ``spans`` are the
    merged [start, end) ranges of words that lie in an occurrence of a window of ``window`` words of a
    benchmark item (an item of fewer words is one window), ``items`` the sorted ids, as strings, of the
    items whose windows occur.

    A benchmark of up to ``block_bytes`` needs no shuffle. A larger one is searched in blocks of about that size, one pass
    over the texts each, of which only what is found is written, by a digest of the text; the documents
    meet it in the end (the smaller side is broadcast if it is measured to be small). Memory per task: one block, and
    a shard of ``shard_words`` words (or one longer text).

    Null texts have no words; items without words or with a null text have no windows; items of null id are
    one item with an empty name; equal rows and ids are rows like any other; empty tables give no rows or no
    hits. Other columns pass through; ``column`` replaces one of that name.
    """
    if column in docs.columns:
        docs = docs.drop(column)
    hits = first = None
    for block in _blocks_of(benchmark, block_bytes):
        wanted = docs.sparkSession.sparkContext.broadcast(astuple(phrases(block, window)))
        if first is None:
            first = wanted
            continue
        found = _searched(docs.select("text"), "found", wanted, shard_words).filter(F.size("found.items") > 0)
        found = stored(found.select(*_digest(), "found.spans", "found.items").distinct())
        hits = found if hits is None else hits.unionByName(found)
    searched = _searched(docs, column, first, shard_words)
    return searched if hits is None else _with_hits(searched, column, hits)


def _digest() -> list[Column]:
    """The numbers that stand for a text; equal texts have equal hits."""
    return [F.xxhash64("text").alias("_t1"), F.xxhash64(F.lit(1), "text").alias("_t2")]


def _with_hits(docs: DataFrame, column: str, hits: DataFrame) -> DataFrame:
    """``docs`` with what further blocks found added to ``column``."""
    no_column = "_" * max(len(name) for name in docs.columns)  # begins no name of the table
    t1, t2, more_spans, more_items = (no_column + end for end in ("_t1", "_t2", "_spans", "_items"))
    lists = [F.flatten(F.collect_list(c)).alias(name) for c, name in (("spans", more_spans), ("items", more_items))]
    more = broadcast_if_small(hits.groupBy(F.col("_t1").alias(t1), F.col("_t2").alias(t2)).agg(*lists))
    keyed = docs.select("*", *[d.alias(name) for d, name in zip(_digest(), (t1, t2), strict=True)]).join(more, [t1, t2], "left")
    own = F.col(column)
    spans = F.array_sort(F.concat(own["spans"], more_spans))

    def add(so_far: Column, span: Column) -> Column:
        last = F.element_at(so_far, -1)
        grown = F.array(last[0], F.greatest(last[1], span[1]))
        joined = F.concat(F.slice(so_far, F.lit(1), F.size(so_far) - 1), F.array(grown))
        return F.when((F.size(so_far) > 0) & (span[0] <= F.try_element_at(so_far, F.lit(-1))[1]), joined).otherwise(F.concat(so_far, F.array(span)))

    merged_spans = F.aggregate(spans, F.array().cast("array<array<bigint>>"), add)
    items = F.array_sort(F.array_distinct(F.concat(own["items"], more_items)))
    whole = F.struct(own["n_words"].alias("n_words"), merged_spans.alias("spans"), items.alias("items"))
    added = F.when(F.col(more_spans).isNotNull(), whole).otherwise(own)
    return keyed.withColumn(column, added).select(*docs.columns)


def _searched(docs: DataFrame, column: str, wanted, shard_words: int) -> DataFrame:
    others = docs.schema.fields
    schema = T.StructType([*others, T.StructField(column, FOUND)])

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = iter(search_shard([b.column("text") for b in held], Phrases(*wanted.value)))
        for rows in held:
            values = [{"n_words": n, "spans": spans, "items": items} for n, spans, items in islice(found, rows.num_rows)]
            columns = [rows.column(f.name) for f in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, _PA_FOUND)], names=[f.name for f in others] + [column])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows in batches:
            held.append(rows)
            # No word is shorter than one byte and a separator.
            size += pc.sum(pc.binary_length(rows.column("text"))).as_py() or 0
            if size >= 6 * shard_words:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return map_batches(docs, run, schema)


def word_ranges(text: str, spans: Iterable) -> list[tuple[int, int]]:
    """Character ranges of word spans, to cut passages out of a text."""
    words = [m.span() for m in _WORD.finditer(text)]
    return [(words[a][0], words[b - 1][1]) for a, b in spans]


def hit_columns(column: str = "found") -> dict:
    """n_words, n_hit, n_items, items_sha256 and contaminated from the struct of :func:`find_passages`.

    A document is contaminated if it has hit words and these are at least a twentieth of its words.
    """
    n_words, items = F.col(column).n_words, F.col(column)["items"]
    n_hit = F.aggregate(F.col(column).spans, F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    return {
        "n_words": n_words,
        "n_hit": n_hit,
        "n_items": F.size(items).cast("bigint"),
        "items_sha256": F.sha2(F.array_join(items, ",").cast("binary"), 256),
        "contaminated": (n_hit > 0) & (20 * n_hit >= n_words),
    }


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    names = docs.columns
    column = "found" + "_" * max(len(n) for n in names)  # no name of the table
    found = find_passages(docs, benchmark, column=column)
    return found.filter(~hit_columns(column)["contaminated"]).select(*names)
