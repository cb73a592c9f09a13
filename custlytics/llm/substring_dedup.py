"""Passages of words that an earlier document has too, by suffixes partitioned by prefixes.

Every window of ``window`` words holds one anchor: of its ``PREFIX_WORDS``-word strings the one with the
least hash, the first of equal ones. Equal windows have equal anchors at the same place, so the suffixes
that begin at a document's windows are partitioned by the words at their anchor rather than by their first
words: neighbouring windows mostly share an anchor and travel as one span, and no text is moved for
anchors that occur in one document only.

1. Spans are range-partitioned by (anchor, span, document) and streamed. Where a span occurs again in a
   later document, all its windows repeat there. Of each span only the first document goes on, and only if
   another span has the same anchor.
2. Anchors are put into groups that fit in memory; the words of one occurrence of each span are brought
   there, and the tree of their suffixes is built level by level: nodes of depth 1, 2, 4 and so on are
   numbered, up to those as deep as a window. A node reached from several documents is a repeat. An anchor
   with too many spans for one group gets the longest prefix, a whole window, as its key.
3. Words of repeats that begin in an earlier document are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from custlytics.llm.common import batch, hash_words, map_batches, mixed, powers, released, settled, word_codes

WINDOW = 50
#: Words of an anchor.
PREFIX_WORDS = 8
#: Spans of one anchor, and of all anchors of one group, whose words may meet in one task.
SPANS_PER_ANCHOR, SPANS_PER_GROUP = 4_000, 20_000

SPANS = "a bigint, span bigint, id bigint, copy bigint, lo int, n int"
STREAMED = f"kind int, {SPANS}"
WORDS = "a bigint, span bigint, id bigint, words array<bigint>"
REPEATS = "a bigint, span bigint, first int, n int"
KEPT = "doc_id bigint, n_words bigint, n_removed bigint, text string"
REPEATED, FIRST = 0, 1

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_LAST_ID = 2**63 - 1
_KEY = ["a", "span", "id", "copy", "lo", "n"]


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


_PA = {ddl: _schema(ddl) for ddl in (SPANS, STREAMED, WORDS, REPEATS, KEPT)}


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word, and where each text's words start."""
    codes, starts, words = word_codes(texts)
    return (hash_words(words)[codes] if len(codes) else np.zeros(0, np.uint64)), starts


def _range_hashes(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words [first, end), whatever their place."""
    upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers(_BASE, len(hashes)))))
    return mixed((upto[end] - upto[first]) * powers(_INVERSE, len(hashes) + 1)[first])


def spans(hashes: np.ndarray, starts: np.ndarray, window: int = WINDOW, prefix: int = PREFIX_WORDS) -> tuple[np.ndarray, ...]:
    """(anchor, span, text, first window, number of windows) of the runs of windows with one anchor.

    First windows are counted from the start of their text."""
    total = len(hashes) - window + 1
    if total <= 0:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int32, np.int32))
    first = np.arange(len(hashes) - prefix + 1)
    value, place = _range_hashes(hashes, first, first + prefix), first
    grams, size = value, 1
    wide = window - prefix + 1
    while size < wide:
        step = min(size, wide - size)
        right = value[step:]
        n = len(right)
        less = right < value[:n]
        value, place = np.where(less, right, value[:n]), np.where(less, place[step:], place[:n])
        size += step
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:total]
    inside = np.arange(total) + window <= starts[1:][text]
    place = place[:total]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    lo = np.flatnonzero(opens)
    closed = np.flatnonzero(inside & np.concatenate((~inside[1:] | opens[1:], [True])))
    n = closed - lo + 1
    whole = _range_hashes(hashes, lo, lo + n + window - 1) ^ mixed(n.astype(np.uint64))
    text = text[lo]
    return grams[place[lo]].view(np.int64), whole.view(np.int64), text, (lo - starts[text]).astype(np.int32), n.astype(np.int32)


def _span_rows(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            a, span, text, lo, n = spans(*word_hashes(rows.column("text")), window)
            of = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(span), rows.column("id").take(of), rows.column("copy").take(of), pa.array(lo), pa.array(n)],
                schema=_PA[SPANS],
            )

    return run


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams one range in order. Holds the first document's places of one span, while its anchor has
    no other span yet; what the range's edges cut is passed on."""
    anchor = span = first = None
    held: list[tuple] = []
    several, edge = False, True
    for rows in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if row[0] != anchor:
                if edge and anchor is not None:
                    out += [(FIRST, *r) for r in held]
                edge = anchor is None
                anchor, span, first, held, several = row[0], row[1], row[2], [], False
            elif row[1] != span:
                span, first, several = row[1], row[2], True
                out += [(FIRST, *r) for r in held]
                held = []
            if row[2] != first:
                out.append((REPEATED, *row))
            elif several:
                out.append((FIRST, *row))
            else:
                held.append(row)
        if out:
            yield batch(_PA[STREAMED], *zip(*out, strict=True))
    if held:
        yield batch(_PA[STREAMED], *zip(*((FIRST, *r) for r in held), strict=True))


def _span_words(window: int):
    """The words of the wanted spans of each document, as hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            hashes, starts = word_hashes(rows.column("text"))
            hashes, out = hashes.view(np.int64), []
            for start, id_, wanted in zip(starts.tolist(), rows.column("id").to_pylist(), rows.column("wanted").to_pylist()):
                for w in wanted:
                    at = start + w["lo"]
                    out.append((w["a"], w["span"], id_, hashes[at : at + w["n"] + window - 1]))
            if out:
                yield batch(_PA[WORDS], *zip(*out, strict=True))

    return run


def deep_nodes(words: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of depth ``depth`` in the tree of suffixes of strings laid one after another.

    Returns for each suffix that is long enough its string, its place there and its node. Nodes of a level
    are numbered by the pairs of nodes of half the depth that they continue."""
    ends = np.cumsum(sizes)
    node, reach = np.unique(words, return_inverse=True)[1].astype(np.int64), 1
    while reach < depth:
        step = min(reach, depth - reach)
        pair = node[:-step] * (len(words) + 1) + node[step:]
        node, reach = np.unique(pair, return_inverse=True)[1].astype(np.int64), reach + step
    place = np.arange(len(node))
    string = np.searchsorted(ends, place, "right")
    whole = place + depth <= ends[string]
    place, string = place[whole], string[whole]
    return string, place - (ends - sizes)[string], node[whole]


def _ranges(string: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring places of a string: (string, first, number)."""
    opens = np.ones(len(place), bool)
    opens[1:] = (string[1:] != string[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(opens)
    return string[first], place[first], np.diff(np.append(first, len(place)))


def _tree(window: int):
    """The windows of a group's spans that a smaller document's span has too."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        words = group.column("words").combine_chunks()
        offsets = words.offsets.to_numpy()
        string, place, node = deep_nodes(words.flatten().to_numpy(), np.diff(offsets), window)
        ids = group.column("id").to_numpy()[string]
        least = np.full(int(node.max()) + 1 if len(node) else 0, _LAST_ID)
        np.minimum.at(least, node, ids)
        again = ids > least[node]
        string, first, n = _ranges(string[again], place[again])
        of = pa.array(string)
        yield pa.RecordBatch.from_arrays(
            [group.column("a").take(of).combine_chunks(), group.column("span").take(of).combine_chunks(),
             pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], schema=_PA[REPEATS],
        )

    return run


def _whole_windows(window: int):
    """Rows (window as two hashes, id, span, place) of spans whose anchor has too many spans."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = [[] for _ in range(6)]
            words = rows.column("words")
            for k, (a, span, id_) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("a", "span", "id")), strict=True)):
                hashes = words[k].values.to_numpy().view(np.uint64)
                first = np.arange(len(hashes) - window + 1)
                one = _range_hashes(hashes, first, first + window).view(np.int64)
                two = _range_hashes(mixed(hashes), first, first + window).view(np.int64)
                n = len(first)
                for column, values in zip(out, (one, two, np.full(n, a), np.full(n, span), np.full(n, id_), first), strict=True):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["w1", "w2", "a", "span", "id", "first"])

    return run


def _identity() -> list[Column]:
    """A null id is the largest; rows of one id are told apart by their text."""
    return [F.coalesce("doc_id", F.lit(_LAST_ID)).alias("id"), F.xxhash64("text").alias("copy")]


def repeated_windows(
    docs: DataFrame, window: int = WINDOW, spans_per_anchor: int = SPANS_PER_ANCHOR, spans_per_group: int = SPANS_PER_GROUP
) -> DataFrame:
    """(id, copy, first, n): runs of n windows, from the first one on, that begin in a document with a
    smaller id too. ``id`` and ``copy`` are those of :func:`_identity`."""
    named = docs.select(*_identity(), "text")
    ordered = map_batches(named, _span_rows(window), SPANS).repartitionByRange(*_KEY).sortWithinPartitions(*_KEY)
    streamed = settled(map_batches(ordered, _streamed, STREAMED))
    repeated = streamed.filter(F.col("kind") == REPEATED).select("id", "copy", F.col("lo").alias("first"), "n")

    # A span that lies across ranges has a first document in each; only the first of all is one.
    firsts = streamed.filter(F.col("kind") == FIRST).drop("kind")
    per_span = firsts.groupBy("a", "span").agg(F.min("id").alias("least"), F.min(F.struct("id", "copy", "lo", "n")).alias("one"))
    per_anchor = per_span.groupBy("a").agg(F.count("*").alias("n_spans"), F.min("least").alias("x"), F.max("least").alias("y"))
    spread = per_anchor.filter((F.col("n_spans") > 1) & (F.col("x") != F.col("y"))).select("a", "n_spans")
    later = firsts.join(per_span.select("a", "span", "least"), ["a", "span"]).filter("id > least").select("id", "copy", F.col("lo").alias("first"), "n")

    wanted = settled(per_span.join(spread, "a").select("a", "span", "n_spans", "one.*"))
    per_doc = wanted.groupBy("id", "copy").agg(F.collect_list(F.struct("a", "span", "lo", "n")).alias("wanted"))
    # Equal rows of the table are read once.
    texts = named.join(per_doc.hint("shuffle_hash"), ["id", "copy"]).dropDuplicates(["id", "copy"])
    words = map_batches(texts.select("id", "text", "wanted"), _span_words(window), WORDS)
    often = wanted.filter(F.col("n_spans") > spans_per_anchor).select("a").distinct()
    words = settled(words)

    n_spans = wanted.count()
    groups = max(1, -(-n_spans // spans_per_group))
    group = F.pmod(F.xxhash64("a"), F.lit(groups)).alias("group")
    common = words.join(often, "a", "left_anti").select(group, "a", "span", "id", "words")
    in_trees = common.groupBy("group").applyInArrow(_tree(window), REPEATS)
    windows = map_batches(words.join(often, "a", "left_semi"), _whole_windows(window), "w1 bigint, w2 bigint, a bigint, span bigint, id bigint, first bigint")
    least = windows.groupBy("w1", "w2").agg(F.min("id").alias("least"))
    alone = windows.join(least, ["w1", "w2"]).filter("id > least").select("a", "span", F.col("first").cast("int").alias("first"), F.lit(1).alias("n"))
    found = in_trees.unionByName(alone)
    # All places of the span in its first document.
    places = firsts.select("a", "span", "id", "copy", "lo").join(per_span.select("a", "span", F.col("least").alias("id")), ["a", "span", "id"])
    inside = places.join(found, ["a", "span"]).select("id", "copy", (F.col("lo") + F.col("first")).alias("first"), "n")
    return repeated.unionByName(later).unionByName(inside)


def _applied(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            n_words, n_removed, texts = [], [], []
            for text, runs in zip(rows.column("text").to_pylist(), rows.column("runs").to_pylist(), strict=True):
                words = (text or "").encode().split()
                edges = np.zeros(len(words) + 1, np.int64)
                for r in runs or []:
                    edges[r["first"]] += 1
                    edges[r["first"] + r["n"] + window - 1] -= 1
                dropped = np.cumsum(edges[:-1]) > 0
                n_words.append(len(words))
                n_removed.append(int(dropped.sum()))
                texts.append(b" ".join(w for w, d in zip(words, dropped.tolist(), strict=True) if not d).decode())
            yield batch(_PA[KEPT], rows.column("doc_id"), n_words, n_removed, texts)

    return run


def drop_repeats(docs: DataFrame, window: int = WINDOW, **sizes: int) -> DataFrame:
    """(doc_id, n_words, n_removed, text): the words left, joined by single spaces, one row per row.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if it lies in a window of ``window`` words
    whose sequence also begins in a document with a smaller doc_id; windows are judged on the input.

    Null texts have no words; texts shorter than a window lose nothing. Rows of one doc_id never take words
    from each other; a null doc_id counts as the largest one. Equal rows give equal rows. An empty table
    gives no rows; other columns are not read.
    """
    named = docs.select("doc_id", "text", *_identity())
    runs = repeated_windows(docs.select("doc_id", "text"), window, **sizes).groupBy("id", "copy").agg(F.collect_set(F.struct("first", "n")).alias("runs"))
    runs = settled(runs)
    released(docs.sparkSession)
    joined = named.join(runs.hint("shuffle_hash"), ["id", "copy"], "left").select("doc_id", "text", "runs")
    return map_batches(joined, _applied(window), KEPT)
