"""Token ids and token counts of texts, looked up by piece.

A text is cut before each single space that follows a character other than white space. No pre-token
reaches over such a place and none depends on what stands before it, so the pieces' tokens, one after
another, are the text's tokens. Each distinct piece of a batch is looked up once; pieces not seen before
go to the tokenizer together.

The library for the file is slow on words it has not met, so the merges of plain pieces are done by
another public one with the file's own vocabulary as ranks. That gives the same ids where the file's
merges are in the order of their ids, which is checked when the file is loaded, and is tested against
the file's library; special strings and rare scripts always go to the file's library.
"""

from __future__ import annotations

import itertools
import json
import os
from collections import ChainMap
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from custlytics.llm.common import gathered, kept_in_worker, map_batches

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Bytes of pieces, with all that is held of them, that a worker remembers from task to task before it starts anew.
REMEMBERED = 160 << 20
#: Longer pieces (characters) are looked up each time; a text without spaces is one piece.
LONGEST_REMEMBERED = 128
#: What a remembered piece takes besides its characters, and what each character may take with its ids.
_PIECE_BYTES, _CHARACTER_BYTES = 180, 20
#: Beyond these characters the two Unicode tables at work (of the pattern and of the tokenizer) might
#: differ, so that such pieces always go to the tokenizer whole.
LAST_COMMON = "ɏ"

COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
_PA_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def load(path: str = TOKENIZER) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core per task
    return Tokenizer.from_file(path)


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], list[str], np.ndarray]:
    """Pieces as numbers, each text's first piece, the strings of pieces that follow a space, the
    strings of pieces that begin a text (numbered on), and which texts can't be cut this way (double
    spaces, or white space before a space); these come out without pieces.
    """
    split = pc.split_pattern(pc.fill_null(texts, ""), " ")
    starts = split.offsets.to_numpy().astype(np.int64)
    encoded = split.values.dictionary_encode()
    codes, dictionary = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary
    strings = dictionary.to_pylist()
    if not len(texts):
        return codes, starts, strings, [], np.zeros(0, bool)
    blank = pc.or_(pc.utf8_is_space(pc.utf8_slice_codeunits(dictionary, -1)), pc.equal(dictionary, ""))
    open_end = blank.to_numpy(zero_copy_only=False)[codes]
    open_end[starts[1:] - 1] = False  # nothing follows
    places = starts[:-1]
    first_codes, first_of = np.unique(codes[places], return_inverse=True)
    firsts = [strings[c] for c in first_codes]
    open_end[places] &= np.array([bool(s) for s in firsts])[first_of]
    codes[places] = len(strings) + first_of
    odd = np.logical_or.reduceat(open_end, places)
    if odd.any():
        keep = ~np.repeat(odd, np.diff(starts))
        codes = codes[keep]
        starts = np.concatenate(([0], np.cumsum(keep)))[starts]
    return codes, starts, strings, firsts, odd


class Growing:
    """An array that numbers are appended to."""

    def __init__(self, kind):
        self.data, self.size = np.zeros(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.zeros(self.size + len(values), self.data.dtype)])
        self.data[self.size : self.size + len(values)] = values
        self.size += len(values)

    def keep(self, n: int) -> None:
        self.size = n
        if len(self.data) > 4 * n + (1 << 16):
            self.data = self.data[: n + 1024].copy()


def _new(strings: list[str], known: dict[str, int]) -> tuple[list[str], list[str]]:
    """The strings that are not known: those to remember, and the long ones."""
    new = [s for s in strings if s not in known]
    return [s for s in new if len(s) <= LONGEST_REMEMBERED], [s for s in new if len(s) > LONGEST_REMEMBERED]


def _numbered(strings: list[str], first: int) -> dict[str, int]:
    return dict(zip(strings, range(first, first + len(strings)), strict=True))


class Pieces:
    """Gives pieces numbers and has :meth:`add` called once for new ones.

    Remembers short pieces and forgets all when they would take more than ``most`` bytes; long ones have
    numbers until the next call only."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.spaced: dict[str, int] = {}
        self.firsts: dict[str, int] = {}
        self.bytes = 0

    def add(self, strings: list[str]) -> None:
        """Takes in what belongs to the next numbers."""
        raise NotImplementedError

    def keep(self, n: int) -> None:
        """Drops all but the first ``n`` numbers."""
        raise NotImplementedError

    def numbers(self, strings: list[str], firsts: list[str]) -> np.ndarray:
        new, long = _new(strings, self.spaced)
        new_firsts, long_firsts = _new(firsts, self.firsts)
        size = sum(_PIECE_BYTES + _CHARACTER_BYTES * len(s) for s in itertools.chain(new, new_firsts))
        if self.bytes and self.bytes + size > self.most:
            self.clear()
            return self.numbers(strings, firsts)
        known = len(self.spaced) + len(self.firsts)
        self.keep(known)
        self.add([" " + s for s in new] + new_firsts + [" " + s for s in long] + long_firsts)
        self.bytes += size
        self.spaced.update(_numbered(new, known))
        self.firsts.update(_numbered(new_firsts, known + len(new)))
        spaced, first = self.spaced, self.firsts
        if long or long_firsts:
            after = len(spaced) + len(first)
            spaced, first = ChainMap(_numbered(long, after), spaced), ChainMap(_numbered(long_firsts, after + len(long)), first)
        return np.array([*map(spaced.__getitem__, strings), *map(first.__getitem__, firsts)], np.int64)


def _byte_stand_ins() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merger:
    """Ids of many strings at once."""

    def __init__(self, path: str = TOKENIZER):
        self.tokenizer = load(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        to_byte, vocab = _byte_stand_ins(), model["vocab"]
        ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab[a + b] for a, b in merges]
        self.ranks = None
        if made == sorted(made) and len(made) + 256 == len(ranks) and (not made or min(made) >= 256):
            self.ranks = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, i in ranks.items():
                self.sizes[i] = len(token)

    def by_library(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def common(self, s: str) -> bool:
        return not s or max(s) <= LAST_COMMON and not any(t in s for t in self.special)

    def __call__(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings, one after another, and how many each has.

        A string that starts with one space and has no white space at its end can follow another such
        string: they are merged as one text, which is then cut where the strings end."""
        if self.ranks is None:
            return _joined(self.by_library(strings))
        whole = "".join(strings)
        plain = self.common(whole)
        chained, found = [], {}
        for place, s in enumerate(strings):
            if not plain and not self.common(s):
                found[place] = self.by_library([s])[0]
            elif len(s) > 1 and s[0] == " " and not s[1].isspace() and not s[-1].isspace():
                chained.append(place)
            else:
                found[place] = np.array(self.ranks.encode_ordinary(s), np.uint32)
        parts, sizes = [], np.zeros(len(strings), np.int64)
        for at in range(0, len(chained), 2000):
            texts = [strings[p] for p in chained[at : at + 2000]]
            ids = np.array(self.ranks.encode_ordinary("".join(texts)), np.uint32)
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(s.encode()) for s in texts])) + 1
            sizes[chained[at : at + 2000]] = np.diff(ends, prepend=0)
            parts.append(ids)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        if found:
            # Put the single ones between the chained ones.
            single = np.array(list(found), np.int64)
            sizes[single] = [len(x) for x in found.values()]
            ends = np.cumsum(sizes)
            out, mine = np.zeros(int(sizes.sum()), np.uint32), np.zeros(int(sizes.sum()), bool)
            for place, x in found.items():
                out[ends[place] - len(x) : ends[place]] = x
                mine[ends[place] - len(x) : ends[place]] = True
            out[~mine] = ids
            ids = out
        return ids, sizes


def _joined(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(found) if found else np.zeros(0, np.uint32)), np.array([len(x) for x in found], np.int64)


class TokenIds(Pieces):
    """Ids of texts as the tokenizer gives them, without special tokens added.

    ``merge`` gives the ids of strings, one after another, and how many each has."""

    def __init__(self, path: str = TOKENIZER, most: int = REMEMBERED, merge: Callable | None = None):
        self.merge = merge or Merger(path)
        super().__init__(most)

    def keep(self, n: int) -> None:
        self.ids.keep(int(self.ends.data[n - 1]) if n else 0)
        self.sizes.keep(n)
        self.ends.keep(n)

    def clear(self) -> None:
        super().clear()
        self.ids, self.sizes, self.ends = Growing(np.uint32), Growing(np.int64), Growing(np.int64)

    def add(self, strings: list[str]) -> None:
        ids, sizes = self.merge(strings)
        self.ends.extend(self.ids.size + np.cumsum(sizes))
        self.ids.extend(ids)
        self.sizes.extend(sizes)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        codes, starts, strings, firsts, odd = cut(texts)
        numbers = self.numbers(strings, firsts)[codes]
        n = self.sizes.data[numbers]
        upto = np.concatenate(([0], np.cumsum(n)))
        out = self.ids.data[np.repeat(self.ends.data[numbers] - upto[1:], n) + np.arange(upto[-1])]
        found = [out[a:b] for a, b in zip(upto[starts[:-1]], upto[starts[1:]], strict=True)]
        for k in np.flatnonzero(odd):
            found[k] = self.merge([texts[int(k)].as_py()])[0]
        return found


def whole_tokens(path: str = TOKENIZER) -> frozenset[str]:
    """The vocabulary's strings that are one pre-token and that the tokenizer encodes alone as one token.

    Byte-level vocabularies hold bytes as stand-in characters; entries that are no whole UTF-8 text
    are no strings. Special tokens are left to the tokenizer.
    """
    tokenizer = load(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    strings = sorted({tokenizer.decoder.decode([t]) for t in tokenizer.get_vocab()} - special - {""})
    strings = [s for s in strings if "�" not in s and max(s) <= LAST_COMMON]
    encoded = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    pattern = regex.compile(public_tokenizers.PATTERN)
    return frozenset(s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1 and pattern.fullmatch(s) and pattern.findall(s) == [s])


class TokenCounts(Pieces):
    """Token counts of texts: whole tokens count one, only other pre-tokens are merged."""

    def __init__(self, whole: frozenset[str], path: str = TOKENIZER, most: int = REMEMBERED):
        self.whole, self.merge = whole, Merger(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        super().__init__(most)

    def clear(self) -> None:
        super().clear()
        self.counts = Growing(np.int64)

    def keep(self, n: int) -> None:
        self.counts.keep(n)

    def count(self, strings: list[str]) -> np.ndarray:
        whole, counts, rest, of = self.whole, [], [], []
        for place, s in enumerate(strings):
            found = self.pattern.findall(s) if self.merge.common(s) else [s]
            others = [p for p in found if p not in whole]
            counts.append(len(found) - len(others))
            rest += others
            of += [place] * len(others)
        numbers = {s: k for k, s in enumerate(dict.fromkeys(rest))}
        sizes = self.merge(list(numbers))[1]
        out = np.array(counts, np.int64)
        np.add.at(out, of, sizes[[numbers[s] for s in rest]])
        return out

    def add(self, strings: list[str]) -> None:
        self.counts.extend(self.count(strings))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        codes, starts, strings, firsts, odd = cut(texts)
        numbers = self.numbers(strings, firsts)[codes]
        upto = np.concatenate(([0], np.cumsum(self.counts.data[numbers])))
        found = (upto[starts[1:]] - upto[starts[:-1]]).astype(np.int64)
        for k in np.flatnonzero(odd):
            found[k] = self.count([texts[int(k)].as_py()])[0]
        return found


def token_counts(docs: DataFrame, limit: int = 512, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of ``docs``.

    Tokens are counted as the tokenizer file at ``path`` (byte-level BPE) gives them, without added
    special tokens; special strings inside a text are special tokens, as is the library's default.
    The whole tokens are proved once on the driver and sent to the tasks; their number is bounded by
    the vocabulary. No shuffle.

    Null and empty texts have no bytes and no tokens; null or repeated ids are rows like any other; an
    empty table gives no rows; other columns are not read.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = kept_in_worker(f"counts {path}", lambda: TokenCounts(whole.value, path))
        for rows in gathered(batches, "text"):
            texts = rows.column("text")
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n_tokens = pa.array(counts(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), n_bytes, n_tokens, pc.greater(n_tokens, limit)], schema=_PA_COUNTS)

    return map_batches(docs.select("doc_id", "text"), run, COUNTS)
