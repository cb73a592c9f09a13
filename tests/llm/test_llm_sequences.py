"""Byte-level BPE, periodic runs and the conversation trie, against plain versions and on odd tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from custlytics.llm import byte_bpe, periodic_runs, prefix_trie, queries, tokens
from custlytics.llm.recompression import Grammar

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "\n\n", "a  b", "naïve 日本語 text", "🙂🙂👩‍👩‍👧", "  tabs\t\tand\r\n", "<|endoftext|>", "don't WE'LL", "x" * 5000, "  z", "é" * 700, "١٢٣ ½ ⅷ", "\x00\x1c"]


@pytest.fixture(scope="module")
def own():
    ranks = byte_bpe.read_ranks(byte_bpe.RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query(spark, own):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == brute.sha(texts[r.doc_id])


def test_bpe_of_every_vocabulary_string_and_random_ones(own):
    ranks = byte_bpe.read_ranks(byte_bpe.RANKS)
    codec = byte_bpe.Codec(byte_bpe._written(byte_bpe.RANKS))
    r = random.Random(5)
    texts = [t for t in (token.decode("utf-8", "ignore") for token in ranks)]
    texts += ["".join(r.choice("ab ész'日🙂1\n") for _ in range(r.randint(1, 40))) for _ in range(5000)] + ODD
    for text, ids in zip(texts, codec.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == own.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_offsets_are_those_of_the_library():
    codec = byte_bpe.Codec(byte_bpe._written(byte_bpe.RANKS))
    for text in ODD + ["plain words only"]:
        ids = codec.encode(pa.array([text]))[0]
        starts, ends, split = codec.offsets(ids, text.encode())
        encoded = codec.tokenizer.encode(text, add_special_tokens=False)
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == encoded.offsets
        assert (split > 0) == any(b"\xef\xbf\xbd" in codec.decode(np.array([i], np.uint32)).decode("utf-8", "replace").encode() for i in ids)


def test_bpe_odd_rows(spark):
    docs = brute.table(spark, brute.odd_rows()).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    rows = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    want = sorted((str(i), (t or "").encode()) for i, t in brute.odd_rows())
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in rows) == want
    assert byte_bpe.encode(brute.empty(spark)).collect() == [] and byte_bpe.decode(byte_bpe.encode(brute.empty(spark))).collect() == []


def test_bpe_rejects_a_vocabulary_that_merges_cannot_make():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256}
    with pytest.raises(ValueError):
        byte_bpe.tokenizer_of(ranks)


def test_pieces_remembered_stay_below_their_bytes():
    r = random.Random(8)
    for cache in (tokens.TokenIds(), tokens.TokenCounts(tokens.whole_tokens())):
        for _ in range(10):
            cache(pa.array(["".join(r.choice("日本語文字列") for _ in range(2000)) for _ in range(200)]))
        assert cache.bytes == 0 and not cache.firsts
        cache(pa.array(["a b"]))
        held = [x for x in vars(cache).values() if isinstance(x, tokens.Growing)]
        assert sum(x.data.nbytes for x in held) < 4 << 20 and cache.bytes < 1000


@pytest.mark.parametrize("size", [1, 2, 5])
def test_bpe_pieces_that_split_characters(spark, own, size):
    texts = {1: "日本語🙂 and é", 2: "🙂" * 9, 3: "plain", None: "ü日"}
    rows = []
    for doc_id, text in texts.items():
        ids = own.encode_ordinary(text)
        rows += [(doc_id, k, bytearray(np.array(ids[k : k + size], "<u4").tobytes())) for k in range(0, len(ids), size)]
    cut = own.encode_ordinary("é日🙂")[:-1]
    rows += [(7, 0, bytearray(np.array(cut, "<u4").tobytes())), (7, 1, None)]
    pieces = spark.createDataFrame(rows, "doc_id bigint, start bigint, ids binary").repartition(3)
    found = defaultdict(str)
    got = byte_bpe.decode_pieces(pieces).collect()
    for r in sorted(got, key=lambda r: r.start):
        found[r.doc_id] += r.text
    assert len(got) == len(rows)
    assert {k: v for k, v in found.items() if k != 7} == texts and found[7].startswith("é日") and found[7].endswith("�")


def plain_runs(words, length=6, exponent=4):
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(length, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(seed, n):
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        words = []
        for _ in range(r.randint(0, 6)):
            unit = [r.choice("abcdefgh"[: r.choice([2, 3, 8])]) for _ in range(r.randint(1, 9))]
            words += (unit * 12)[: r.randint(0, 60)]
        texts.append(r.choice([" ", "\n", "  "]).join(words))
    return texts


def test_common_extensions():
    r = random.Random(3)
    for _ in range(60):
        unit = [r.randrange(3) for _ in range(r.randint(1, 7))]
        inner = r.choice([(unit * 30)[: r.randint(1, 60)], [r.randrange(2) for _ in range(r.randint(1, 60))]])
        s = [8, *inner, 9]
        i, j = np.array([(a, b) for a in range(len(s)) for b in range(len(s)) if a != b]).T
        grammar = Grammar(np.array(s))
        for step in (1, -1):
            for a, b, got in zip(i.tolist(), j.tolist(), grammar.extension(i, j, step).tolist(), strict=True):
                n = 0
                while 0 <= a + step * n < len(s) and 0 <= b + step * n < len(s) and s[a + step * n] == s[b + step * n]:
                    n += 1
                assert n == got


@pytest.mark.parametrize("length,exponent", [(6, 4), (2, 2), (10, 3)])
def test_runs(spark, length, exponent, monkeypatch):
    monkeypatch.setattr(periodic_runs, "PLACES", 50)
    rows = brute.odd_rows() + [(100 + k, t) for k, t in enumerate(repetitive(length, 80))]
    rows += [(90, "same " * 3000), (91, "a b " * 1500 + "c " + "a b " * 10)]
    got = periodic_runs.find_runs(brute.table(spark, rows), length, exponent).collect()
    want = []
    for i, t in rows:
        words = brute.blank_split(t)
        runs = plain_runs(words, length, exponent)
        want.append(str((i, len(words), runs, plain_collapsed(words, runs))))
    assert sorted(str((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text)) for r in got) == sorted(want)
    assert periodic_runs.find_runs(brute.empty(spark)).collect() == []


def test_runs_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    with_runs = 0
    for d in docs:
        words = brute.blank_split(d.text)
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        r = found[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == brute.sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == brute.sha(plain_collapsed(words, runs))
        with_runs += bool(runs)
    assert len(found) == len(docs) and with_runs > 5


def plain_trie(rows, rebuild):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    if rebuild:
        made = {}
        for c, own in convs.items():
            h = zlib.crc32(str(c).encode()) % 4
            made[c] = convs.get(c - c % 20, [])[:h] + own[h:]
        convs = made
    members, ends, children = defaultdict(set), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, cs in members.items():
        own = (len(cs) - 1) * len(brute.blank_split(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += own
    return sorted(
        str((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children[node]), leaves[node], saved[node], brute.sha(",".join(map(str, sorted(ends[node]))))))
        for node, cs in members.items()
    )


def talks(seed, long=()):
    r = random.Random(seed)
    rows = []
    for c in range(120):
        for turn in range(r.choice([1, 2, 2, 3, 5, 9])):
            rows.append((c, turn or None, r.choice(["user", None, "assistant"]), r.choice(["a", "a b", "", None, "c  d\ne"])))
    for c, n in long:
        rows += [(c, turn, "user", f"t {turn % 5 if turn < 40 else c % 2}") for turn in range(n)]
    rows += [(200, 0, "user", "hot first turn"), (None, 0, "user", "of no conversation")]
    rows += [(c, turn, "user", "copy") for c in range(300, 360) for turn in range(3)]
    return [(*row, "x", 1, "y") for row in rows]


TALK = "conv_id bigint, turn bigint, role string, text string, pos string, depth int, words string"


@pytest.mark.parametrize("rebuild", [False, True])
@pytest.mark.parametrize("band,shard_rows,group_rows", [(4096, 500_000, None), (8, 50, 30)])
def test_trie(spark, rebuild, band, shard_rows, group_rows):
    rows = talks(band, long=[(400, 100), (401, 100), (402, 64), (404, 33), (407, 16), (409, 8)])
    turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, TALK).repartition(5), group_rows)
    paths = prefix_trie.shared_head_paths(turns) if rebuild else prefix_trie.paths(turns)
    got = prefix_trie.trie(paths, shard_rows, band).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_trie(rows, rebuild)


def test_trie_of_few_conversations(spark):
    empty = spark.createDataFrame([], TALK)
    assert prefix_trie.shared_head_trie(empty).collect() == [] and prefix_trie.conversation_trie(empty).collect() == []
    # Conversation 21 loses its only turn and has no donor: a root that is its own leaf.
    bare = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    rows = [(bare, None, None, None, "x", 1, "y")]
    got = prefix_trie.shared_head_trie(spark.createDataFrame(rows, TALK)).collect()
    assert [tuple(r) for r in got] == [(bare, 0, None, 1, 0, 1, 0, brute.sha(str(bare)))]


def test_hash_without_gaps():
    keys = np.unique(np.random.Generator(np.random.PCG64(1)).integers(0, 2**64, 20_000, np.uint64))
    found = prefix_trie.MinimalPerfectHash(keys)
    assert np.array_equal(np.sort(found(keys)), np.arange(len(keys)))
    table = prefix_trie.NodeTable(np.array([1, 1, 2, 1]), np.array([5, 6, 5, 5]))
    assert len(table.p1) == 3
    with pytest.raises(KeyError):
        table.slots(np.array([2]), np.array([6]))
