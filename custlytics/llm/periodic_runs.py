"""Periodic runs of words inside a document, and documents without the repeats.

A run is a stretch of words with smallest period q, at least ``min_exponent`` times as long as q, that no
neighbouring word extends. It covers ``min_exponent`` multiples of q, counted from the document's begin, and its
words there are equal: such places of the grid 0, q, 2q, ... are candidates, in all n/1 + n/2 + ... of
them. The exact ends come from common extensions of a place and the next one to both sides, asked of a grammar of
the documents that have candidates.

A batch of documents is one sequence with a number of its own between any two documents, so that extensions
end there. Rows stay in place: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from custlytics.llm.common import gathered, map_batches, word_codes
from custlytics.llm.recompression import Grammar

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Places of the grid that are compared, and extensions that are asked for, at once.
PLACES, QUERIES = 2_000_000, 500_000

RUN = "struct<start:bigint,length:bigint,period:bigint>"
FOUND = f"doc_id bigint, n_words bigint, runs array<{RUN}>, text string"


def candidates(codes: np.ndarray, starts: np.ndarray, exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods where ``exponent`` places of a document's grid, one after another, have equal words.

    ``codes`` are the words of all documents, ``starts`` where each begins and the end of the last."""
    n_words = np.diff(starts)
    n_periods = n_words // exponent
    first = np.repeat(starts[:-1], n_periods)
    upto = np.concatenate(([0], np.cumsum(n_periods)))
    period = np.arange(upto[-1]) - np.repeat(upto[:-1], n_periods) + 1
    n_places = (np.repeat(n_words, n_periods) - 1) // period + 2 - exponent
    ends = np.cumsum(n_places)
    found_places, found_periods, at = [], [], 0
    while at < len(period):
        end = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES, "right")), at + 1)
        n = n_places[at:end]
        q = np.repeat(period[at:end], n)
        number = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(first[at:end], n) + number * q
        for k in range(1, exponent):
            equal = codes[place + (k - 1) * q] == codes[place + k * q]
            place, q = place[equal], q[equal]
        found_places.append(place)
        found_periods.append(q)
        at = end
    if not found_places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_places), np.concatenate(found_periods)


def find(codes: np.ndarray, starts: np.ndarray, length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document number, first word (in the document), length and period of all runs, by document, first word
    and period."""
    places, periods = candidates(codes, starts, exponent)
    none = np.zeros(0, np.int64)
    if not len(places):
        return none, none, none, none
    docs = np.searchsorted(starts, places, "right") - 1
    # The sequence of the documents at work: a number of its own before each and at the end.
    used = np.unique(docs)
    sizes = starts[used + 1] - starts[used]
    begins = np.cumsum(sizes) - sizes + np.arange(len(used)) + 1  # where each begins in the sequence
    sequence = np.zeros(int(sizes.sum()) + len(used) + 1, np.int64)
    marks = np.append(begins - 1, len(sequence) - 1)
    words = np.ones(len(sequence), bool)
    words[marks] = False
    sequence[words] = codes[np.repeat(starts[used] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
    sequence[marks] = int(codes.max()) + 1 + np.arange(len(marks))
    grammar = Grammar(sequence)

    shift = begins - starts[used]
    found = []
    for at in range(0, len(places), QUERIES):
        q, doc = periods[at : at + QUERIES], docs[at : at + QUERIES]
        moved = shift[np.searchsorted(used, doc)]
        i = places[at : at + QUERIES] + moved
        ahead, back = grammar.extension(i, i + q, 1), grammar.extension(i - 1, i + q - 1, -1)
        total = back + q + ahead
        long_enough = total >= np.maximum(length, exponent * q)
        found.append(np.unique(np.stack([doc, i - back - moved - starts[doc], total, q])[:, long_enough], axis=1))
    doc, start, total, q = np.unique(np.concatenate(found, axis=1), axis=1)
    # A run is found with multiples of its period as well: of one stretch the first has the least.
    smallest = np.ones(len(doc), bool)
    smallest[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]) | (total[1:] != total[:-1])
    doc, start, total, q = (c[smallest] for c in (doc, start, total, q))
    order = np.lexsort((q, start, doc))
    return doc[order], start[order], total[order], q[order]


def _collapsed(codes: np.ndarray, starts: np.ndarray, words: pa.Array, runs: tuple[np.ndarray, ...]) -> pa.Array:
    """Texts of the words that no run contains after its first period, joined by one space."""
    doc, start, length, period = runs
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, starts[doc] + start + period, 1)
    np.add.at(change, starts[doc] + start + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    upto = np.concatenate(([0], np.cumsum(kept)))[starts]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), words.take(pa.array(codes[kept]))), " ")


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, text), one row per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs`` has (start, length, period) of every maximal
    stretch of words with smallest period ``period`` that is at least ``min_length`` words and ``min_exponent`` (two or
    more) periods long, by start and then period. ``text`` has the words that no run contains after the
    run's first period, joined by one space.

    Null, empty and blank texts have no words, no runs and an empty text. Null or repeated ids are rows like
    any other; an empty table gives no rows; other columns are not read. Texts are read whole.
    """
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in gathered(batches, "text"):
            codes, starts, words = word_codes(rows.column("text"))
            runs = find(codes, starts, min_length, min_exponent)
            upto = np.searchsorted(runs[0], np.arange(rows.num_rows + 1))
            names = ["start", "length", "period"]
            structs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in runs[1:]], names)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(np.diff(starts), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(upto, pa.int32()), structs),
                    _collapsed(codes, starts, words, runs),
                ],
                names=["doc_id", "n_words", "runs", "text"],
            )

    return map_batches(docs.select("doc_id", "text"), run, FOUND)


def longest_run(runs: Column) -> Column:
    """The run of greatest length; of equal ones that of smallest start, then period. Null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    return F.when(F.size(runs) > 0, F.struct((-best.start).alias("start"), best.length.alias("length"), (-best.period).alias("period")))


def run_lines(runs: Column) -> Column:
    """``start,length,period`` and a line feed for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs`` where about one document in ten gets a periodic end, chosen by its id.

    With h the CRC-32 of the decimal doc_id and g = h // 10, a document of n words with h % 10 = 0 repeats the
    1 + (n - a) // (3 + g % 8) words from word a = g % n on until its end, its words joined by one space.
    All other texts are unchanged, also those of null doc_ids, and texts without words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    split = chosen.withColumn("words", F.when(F.col("g").isNotNull(), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)))
    sized = split.withColumn("n", F.when(F.size("words") > 0, F.size("words")))
    placed = sized.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda k: F.get("words", F.col("a") + k % F.col("p")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))
