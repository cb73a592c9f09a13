"""Byte-level BPE ids of texts with character offsets, and texts of ids.

A rank file becomes a tokenizer of the ``tokenizers`` library once, on the driver: bytes are written as
stand-in characters, and each vocabulary string gets the one merge that makes it. Every string must be, alone,
the merge of two strings of lower rank (checked), so that merging pairs in that order gives the ids that
merging by rank gives. Tasks get the finished tokenizer, whose size is that of the vocabulary, and work on
Arrow batches: the batch is cut into pieces at spaces (where no pre-token reaches over), and the library
encodes each distinct piece once. No shuffle.

Offsets do not come from the library: a token's bytes are known, so the running sum of their number places it
in the text's bytes, and a count of the bytes that begin a character turns places into characters.
"""

from __future__ import annotations

import base64
import codecs
import functools
import os
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from custlytics.llm.common import kept_in_worker, map_batches
from custlytics.llm.tokens import Merger, TokenIds

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Bytes of pieces that a worker remembers.
REMEMBERED = 64 << 20

ENCODED = "doc_id bigint, n_tokens bigint, n_split bigint, ids binary, starts array<int>, ends array<int>"
_PA_ENCODED = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_split", pa.int64()), ("ids", pa.binary()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))]
)


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable in Latin-1, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What is left of ``token`` when all merges of lower rank are done."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        made = [ranks.get(a + b, len(ranks)) for a, b in zip(parts, parts[1:], strict=False)]
        least = min(made)
        if least >= ranks[token]:
            break
        at = made.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def tokenizer_of(ranks: dict[bytes, int]) -> Tokenizer:
    """The library's tokenizer with these ranks as ids; each match of the public pattern is merged separately."""
    written = byte_characters()
    as_text = {token: "".join(written[b] for b in token) for token in ranks}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__):
        parts = _last_merge(token, ranks)
        if len(parts) != 2:
            raise ValueError(f"no merge of two strings of lower rank makes {token!r}")
        merges.append(tuple(as_text[p] for p in parts))
    made = Tokenizer(models.BPE(vocab={as_text[t]: i for t, i in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return made


class LibraryMerger(Merger):
    """Ids of many strings by the library; strings that can follow one another go to it as one text."""

    def __init__(self, tokenizer: Tokenizer, sizes: np.ndarray):
        self.tokenizer, self.sizes, self.ranks = tokenizer, sizes, self

    def common(self, s: str) -> bool:
        return True

    def encode_ordinary(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Codec:
    """Encodes texts and decodes ids; made from what the library wrote of a tokenizer."""

    def __init__(self, written: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        self.tokenizer = Tokenizer.from_str(written)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocab = self.tokenizer.get_vocab()
        tokens = [b""] * (max(vocab.values()) + 1)
        for text, i in vocab.items():
            tokens[i] = bytes(byte_of[c] for c in text)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

        self.ids = TokenIds(most=REMEMBERED, merge=LibraryMerger(self.tokenizer, self.sizes))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        return self.ids(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        return self.bytes[np.arange(total) + np.repeat(self.firsts[ids] - upto + sizes, sizes)].tobytes()

    def offsets(self, ids: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """First character and end of each token, and how many tokens begin or end inside a character.
        A token that holds a part of a character spans the whole of it."""
        begins = np.concatenate(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, [True]))
        upto = np.concatenate(([0], np.cumsum(begins[:-1])))  # characters begun before each byte
        end = np.cumsum(self.sizes[ids])
        start = end - self.sizes[ids]
        split = ~begins[start] | ~begins[end]
        return (upto[start] - ~begins[start]).astype(np.int32), upto[end].astype(np.int32), int(split.sum())


def _codec(sent) -> Codec:
    path, written = sent.value
    return kept_in_worker(f"byte bpe {path}", lambda: Codec(written))


@functools.lru_cache(maxsize=4)
def _written(path: str) -> str:
    return tokenizer_of(read_ranks(path)).to_str()


def _sent(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast((path, _written(path)))


def encode(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, n_tokens, n_split, ids, starts, ends), one row per row of ``docs``.

    ``ids`` are little-endian unsigned 32-bit numbers one after another; ``starts`` and ``ends`` the characters
    (code points, end exclusive) of each token; ``n_split`` counts tokens that begin or end inside a
    character. No special tokens: their strings are ordinary text.

    Null and empty texts have no tokens; null or repeated ids are rows like any other; an empty table gives
    no rows; other columns are not read. A text is encoded whole, however long.
    """
    sent = _sent(docs, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for rows in batches:
            texts = pc.fill_null(rows.column("text"), "").to_pylist()
            found = codec.encode(rows.column("text"))
            placed = [codec.offsets(ids, text.encode()) for ids, text in zip(found, texts, strict=True)]
            columns = [rows.column("doc_id"), [len(x) for x in found], [p[2] for p in placed], [x.astype("<u4").tobytes() for x in found]]
            columns += [[p[0] for p in placed], [p[1] for p in placed]]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _PA_ENCODED, strict=True)], schema=_PA_ENCODED
            )

    return map_batches(docs.select("doc_id", "text"), run, ENCODED)


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ``ids`` (as :func:`encode` writes them).

    Bytes and not text, as ids may be a part of a text that begins or ends inside a character;
    :func:`decode_pieces` gives texts of such parts. Null or no ids give no bytes; an empty table gives no
    rows; repeated rows and further columns stay, but a column named ``decoded`` is replaced.
    An id that is not in the vocabulary is an error.
    """
    sent = _sent(encoded, path)
    kept = encoded.drop("decoded")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for rows in batches:
            out = [codec.decode(np.frombuffer(ids or b"", "<u4")) for ids in rows.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.binary())], names=[*rows.schema.names, "decoded"])

    return map_batches(kept, run, kept.withColumn("decoded", F.lit(b"")).schema)


def decode_pieces(pieces: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, start, text) of parts (doc_id, start, ids) of documents; ``start`` orders a document's parts.

    A character whose bytes lie in several parts comes out with the part that completes it, so that a
    document's texts, one after another, are its text. Bytes that never become a character (a missing part,
    an unfinished end) are replaced by U+FFFD, at the latest in a document's last part.

    Parts stream through one task per document in order and are not held. Null ids are no bytes; null
    doc_ids are one document; parts of equal ``start`` go in the order of their ids; an empty table gives
    no rows; other columns are not read.
    """
    sent = _sent(pieces, path)
    laid_out = pieces.select(F.col("doc_id").cast("bigint"), F.col("start").cast("bigint"), "ids").repartition("doc_id").sortWithinPartitions("doc_id", "start", "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, reader, held = _codec(sent), None, None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "start", "text"])

        for rows in batches:
            out = []
            for doc_id, start, ids in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "ids")), strict=True):
                if held is not None and held[0] != doc_id:
                    out.append((*held[:2], held[2] + reader.decode(b"", True)))
                    held = None
                if held is None:
                    reader = codecs.getincrementaldecoder("utf-8")("replace")
                else:
                    out.append(held)
                held = (doc_id, start, reader.decode(codec.decode(np.frombuffer(ids or b"", "<u4"))))
            if out:
                yield made(out)
        if held is not None:
            yield made([(*held[:2], held[2] + reader.decode(b"", True))])

    return map_batches(laid_out, run, "doc_id bigint, start bigint, text string")
