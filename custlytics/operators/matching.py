"""What runs in Python workers: which of many words a text contains.

The module is shipped with the tasks, so workers need no copy of this package.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def words_in(words, text: str, found: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches with a column ``text``: the other columns and ``found``, the ascending numbers of the words
    that the text contains anywhere. ``words`` is a broadcast list of (word, number)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for word, number in words.value:
            automaton.add_word(word, number)
        automaton.make_automaton()
        for rows in batches:
            numbers = [sorted({n for _, n in automaton.iter(t)}) for t in rows.column(text).to_pylist()] if words.value else [[]] * rows.num_rows
            rest = [name for name in rows.schema.names if name != text]
            yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in rest], pa.array(numbers, pa.list_(pa.int64()))], names=[*rest, found])

    return run
