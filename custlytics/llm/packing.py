"""Sum-of-squares packing of documents into fixed-length sequences.

Each task packs the documents of its partition on their own. A document's full windows are sequences of
their own; the rest of it goes to the fill level that keeps the sum of squared counts of partially
filled windows smallest, tracked in an array of counts by level. The last rests of a partition are cut
into the gaps that are still open.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from custlytics.llm.common import batch, gathered, kept_in_worker, map_batches
from custlytics.llm.tokens import TOKENIZER, TokenIds

WINDOW = 2048
END_ID = 1
#: Tokens of rests that are kept back to fill the gaps at a partition's end.
RESERVE_TOKENS = 2_000_000

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)
_PA_PIECES = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])
_PA_IDS = _PA_PIECES.append(pa.field("ids", pa.list_(pa.int32())))


class Levels:
    """Open windows by fill level."""

    def __init__(self, size: int = WINDOW):
        self.size, self.opened = size, 0
        self.counts = np.zeros(size + 1, np.int64)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def new(self) -> int:
        self.opened += 1
        return self.opened - 1

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) for a rest that is shorter than a window and stays whole.

        From level h to h + length the sum of squares changes by 2 (N[h + length] - N[h] + 1); a full
        window and an untouched one count nothing. Of equal changes the fullest level wins.
        """
        counts, size = self.counts, self.size
        best, level = 2 * counts[length] + 1, 0
        here = counts[1 : size - length + 1]
        held = np.flatnonzero(here)
        if len(held):
            change = 2 * (counts[held + 1 + length] - here[held] + 1)
            if held[-1] + 1 + length == size:
                change[-1] = 1 - 2 * here[held[-1]]
            k = len(held) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= best:
                level = int(held[k]) + 1
        if level:
            window = self.windows[level].pop()
            counts[level] -= 1
        else:
            window = self.new()
        self._put(window, level + length)
        return window, level

    def _put(self, window: int, level: int) -> None:
        if level < self.size:
            self.windows[level].append(window)
            self.counts[level] += 1

    def gaps(self) -> int:
        return int(self.counts @ (self.size - np.arange(self.size + 1)))

    def fullest_first(self) -> Iterator[tuple[int, int]]:
        """(window, level) of the open windows, which are then no longer held."""
        for level in range(self.size - 1, 0, -1):
            for window in self.windows[level]:
                yield window, level


class Packer:
    """Pieces (document, start, ids, tokens of the document, window, offset) of a stream of documents."""

    def __init__(self, size: int = WINDOW, reserve: int = RESERVE_TOKENS):
        self.size, self.most, self.levels = size, reserve, Levels(size)
        self.rests: deque = deque()
        self.held = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        n, start = len(ids), 0
        while n - start >= self.size:
            yield doc, start, ids[start : start + self.size], n, self.levels.new(), 0
            start += self.size
        if start < n:
            self.rests.append((doc, start, ids[start:].copy(), n))
            self.held += n - start
        while self.held > self.most:
            yield self._oldest()

    def _oldest(self) -> tuple:
        doc, start, ids, n = self.rests.popleft()
        self.held -= len(ids)
        return doc, start, ids, n, *self.levels.place(len(ids))

    def finish(self) -> Iterator[tuple]:
        """Rests stay whole until those left fit the gaps; these are cut into the gaps."""
        while self.held > self.levels.gaps():
            yield self._oldest()
        rests, self.rests, self.held = self.rests, deque(), 0
        for window, level in self.levels.fullest_first():
            while level < self.size and rests:
                doc, start, ids, n = rests.popleft()
                fits = self.size - level
                yield doc, start, ids[:fits], n, window, level
                level += min(fits, len(ids))
                if len(ids) > fits:
                    rests.appendleft((doc, start + fits, ids[fits:], n))


def pack(docs: DataFrame, size: int = WINDOW, reserve: int = RESERVE_TOKENS, path: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens, one row per piece.

    A document is its text's ids (null: none) and then id 1. ``start`` counts the document's ids before
    the piece, ``offset`` those before it in its sequence, gapless from 0; ``ids_crc32`` is of the ids as
    little-endian 32-bit numbers; with ``with_ids`` a last column has the ids. All sequences are to be
    padded to ``size``; at most about one per partition is shorter, as long as the partition's open gaps
    stay below ``reserve`` tokens.

    A sequence belongs to one partition, whose number is in the upper bits of ``sequence_id``; no shuffle,
    and a lost task is run again on its own. Memory per task: some megabytes of texts and
    their ids, the reserve, an array of levels and the pieces that a worker remembers. Null or repeated ids and equal rows are documents like any other; an empty table gives no
    rows; other columns are not read.
    """

    def rows(pieces: Iterable[tuple], base: int) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in range(7 + with_ids)]
        for doc, start, ids, n, window, offset in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            row = (doc, start, len(ids), crc, n, base + window, offset, *([ids.astype(np.int32)] if with_ids else ()))
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        if columns[0]:
            yield batch(_PA_IDS if with_ids else _PA_PIECES, *columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = kept_in_worker(f"ids {path}", lambda: TokenIds(path)), Packer(size, reserve)
        base = TaskContext.get().partitionId() << 33
        for docs in gathered(batches, "text"):
            ids = encode(docs.column("text"))
            ids = [np.append(x, np.uint32(END_ID)) for x in ids]
            named = zip(docs.column("doc_id").to_pylist(), ids, strict=True)
            yield from rows((piece for doc, x in named for piece in packer.add(doc, x)), base)
        yield from rows(packer.finish(), base)

    return map_batches(docs.select("doc_id", "text"), run, PIECES + (", ids array<int>" if with_ids else ""))
