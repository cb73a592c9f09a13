"""What runs in Python workers: JSON text cut at closing braces.

The module is shipped with the tasks, so workers need no copy of this package.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STRING = re.compile(r'"(?:[^"\\]++|\\.)*+"', re.DOTALL)
_REST_OF_STRING = re.compile(r'(?:[^"\\]++|\\.)*+"', re.DOTALL)

#: Inside a string or not, and how many brackets are open.
Place = tuple[bool, int]


def after(place: Place, piece: str) -> Place:
    """The place after a piece and the brace that ends it."""
    inside, depth = place
    if inside:
        closing = _REST_OF_STRING.match(piece)
        if closing is None:
            return place
        piece = piece[closing.end() :]
    bare = _STRING.sub("", piece) if '"' in piece else piece
    opened = bare.find('"')
    if opened >= 0:
        bare = bare[:opened]
    depth += bare.count("{") + bare.count("[") - bare.count("]")
    return (True, depth) if opened >= 0 else (False, depth - 1)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The pieces of each block (file, first byte), in order."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value")), strict=True))
    for key, group in groupby(rows, key=lambda row: row[:2]):
        yield key, (row[2] for row in group)


def summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, first, inside0, depth0, inside1, depth1): a block's first character, and where it ends if it
    begins outside or inside of a string."""
    for (file, block), pieces in _blocks(batches):
        outside, inside, first = (False, 0), (True, 0), ""
        for piece in pieces:
            first = first or piece.lstrip("﻿ \t\r\n")[:1]
            outside, inside = after(outside, piece), after(inside, piece)
        columns = [[file], [block], [first], *[[x] for x in (*outside, *inside)]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["file", "block", "first", "inside0", "depth0", "inside1", "depth1"])


def records(starts, fragments: bool, rows: int = 1000) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(file, block, part, opens, value): the objects that lie wholly in a block, or with ``fragments`` the others'
    parts: part 0 what belongs to an object of an earlier block, part 1 (``opens``) the begin of one that goes on.

    ``starts`` is a broadcast map of (file, block) to (inside, depth, depth between two objects)."""
    names, kinds = ["file", "block", "part", "opens", "value"], [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]

    def found(file: str, block: int, pieces: Iterator[str]) -> Iterator[tuple]:
        inside, depth, between = starts.value[file, block]
        place, held, begun_before = (inside, depth), [], inside or depth > between
        for piece in pieces:
            place = after(place, piece)
            held += (piece, "}")
            if place == (False, between):
                text = "".join(held)
                if begun_before:
                    if fragments:
                        yield file, block, 0, False, text
                elif not fragments and "{" in text:
                    yield file, block, 0, False, text[text.index("{") :]
                held, begun_before = [], False
        text = "".join(held)
        if fragments and begun_before:
            yield file, block, 0, False, text
        elif fragments and "{" in text and (place[0] or place[1] > between):
            yield file, block, 1, True, text[text.index("{") :]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (file, block), pieces in _blocks(batches):
            for row in found(file, block, pieces):
                out.append(row)
                if len(out) == rows:
                    yield made(out)
                    out = []
        yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run
