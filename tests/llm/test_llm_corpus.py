"""Operators that compare documents: against brute force, on odd tables and in both ways of laying out hot keys."""

from __future__ import annotations

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from custlytics.llm import components, decontamination, fm_index, line_dedup, ngram_join, quality_rules, queries, sharding, substring_dedup

SF = "/root/testdata/sf0.001"


def as_text(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    ok, note = compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])
    assert ok, note


@pytest.mark.parametrize("keep_first", [False, True])
def test_line_dedup(spark, keep_first):
    r = random.Random(4)
    rows = brute.odd_rows() + [(100 + i, "\n".join(f"line {r.choice('ABCab')} " for _ in range(r.randint(1, 6)))) for i in range(60)]
    got = line_dedup.drop_lines(brute.table(spark, rows), min_docs=5, keep_first=keep_first).collect()
    assert as_text(tuple(x) for x in got) == as_text(brute.line_dedup(rows, 5, keep_first))
    assert line_dedup.drop_lines(brute.empty(spark)).collect() == []


def test_lines_of_one_key_in_many_ranges(spark):
    """Each range holds a few documents of the key; no range alone need reach the threshold."""
    rows = [(i, "hot\nown " + str(i)) for i in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for threshold in (10, 40, 41):
            got = line_dedup.drop_lines(brute.table(spark, rows), min_docs=threshold).collect()
            assert as_text(tuple(x) for x in got) == as_text(brute.line_dedup(rows, threshold))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_dedup_documents_keeps_the_columns(spark):
    rows = [(i, t) for i, t in brute.odd_rows() if i is not None]
    docs = brute.table(spark, rows).withColumn("n_chars", F.length("text").cast("bigint"))
    kept = line_dedup.dedup_documents(docs, min_docs=5)
    assert kept.columns == docs.columns
    texts = {r.doc_id: (r.text, r.n_chars, r.found) for r in kept.collect()}
    assert texts[0][0].startswith("The same line") and texts[1] == ("own words of 1 and more of 7", 28, "f")


def passages(seed):
    r = random.Random(seed)
    voc = [f"w{k}" for k in range(30)]
    shared = [[r.choice(voc) for _ in range(r.choice([12, 20, 35]))] for _ in range(5)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(r.randint(0, 4)):
            words += r.choice([r.choice(shared), [r.choice(voc) for _ in range(r.randint(1, 30))], ["z"] * r.randint(1, 40), r.choice(shared)[3:]])
        rows.append((i, r.choice([" ", "\n"]).join(words)))
    return [*rows, (None, rows[20][1]), (7, rows[7][1]), (8, rows[9][1]), *brute.odd_rows()[12:]]


@pytest.mark.parametrize("sizes", [{}, {"spans_per_anchor": 1, "spans_per_group": 7}])
def test_substring_dedup(spark, sizes):
    rows = passages(1)
    got = substring_dedup.drop_repeats(brute.table(spark, rows), 12, **sizes).collect()
    assert as_text(tuple(x) for x in got) == as_text(brute.drop_repeats(rows, 12))


def test_empty_substring_dedup(spark):
    assert substring_dedup.drop_repeats(brute.empty(spark)).collect() == []


def test_spans_hold_every_window_once():
    r = random.Random(3)
    for _ in range(100):
        texts = [" ".join(r.choice("abcde") for _ in range(r.randint(0, 60))) for _ in range(4)]
        hashes, starts = substring_dedup.word_hashes(pa.array(texts))
        _, _, text, lo, n = substring_dedup.spans(hashes, starts, 12, 4)
        found = sorted((int(t), int(a) + j) for t, a, m in zip(text, lo, n) for j in range(m))
        assert found == sorted((t, k) for t, x in enumerate(texts) for k in range(len(x.split()) - 11))


def near_copies(seed):
    r = random.Random(seed)
    voc = [f"w{k}" for k in range(60)]
    bases = [[r.choice(voc) for _ in range(r.choice([3, 5, 20, 40, 90]))] for _ in range(12)]
    line, rows = [r.choice(voc) for _ in range(12)], []
    for i in range(200):
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            words[r.randrange(len(words))] = r.choice(voc)
        rows.append((i, r.choice([" ", "\n"]).join(words + line * (r.random() < 0.3)).replace("w1", "W1")))
    return [*rows, (5, rows[5][1]), *((i, t) for i, t in brute.odd_rows()[12:] if i is not None)]


@pytest.mark.parametrize("options", [{}, {"pairs_per_row": 0, "pivot_rounds": 2, "rows_per_task": 5}])
def test_ngram_join(spark, options):
    rows = near_copies(2)
    got = ngram_join.near_duplicates(brute.table(spark, rows), **options).collect()
    assert as_text((r.doc_id, r.n_shingles, r.component_id) for r in got) == as_text(brute.near(rows))


def test_representatives(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, "x y z u v w"), (5, "x y z u v w")]
    kept = ngram_join.keep_representatives(brute.table(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5] and kept.columns == brute.table(spark, rows).columns
    assert ngram_join.near_duplicates(brute.empty(spark)).collect() == []


def test_prefixes_of_similar_sets_meet():
    r = random.Random(6)
    for _ in range(400):
        a = r.sample(range(400), r.randint(1, 60))
        b = list({*a[r.randint(0, 4) :], *r.sample(range(400), r.randint(0, 4))})
        both = len({*a} & {*b})
        if 100 * both >= 85 * (len(a) + len(b) - both):
            shared = 1 + min(len(a), len(b)) // ngram_join.GRAMS_PER_SHARED
            for least in (1, shared):
                first = [set(sorted(x)[: ngram_join.prefix_length(len(x), shared=least)]) for x in (a, b)]
                assert len(first[0] & first[1]) >= least


def test_reach_holds_every_similar_set():
    r = random.Random(8)
    for _ in range(400):
        a = r.sample(range(400), r.randint(1, 60))
        b = list({*a[r.randint(0, 6) :], *r.sample(range(400), r.randint(0, 6))})
        both = {*a} & {*b}
        if both and 100 * len(both) >= 85 * (len(a) + len(b) - len(both)):
            for one, other in ((a, b), (b, a)):
                assert ngram_join.reaches(len(one))[sorted(one).index(min(both))] >= len(other)


def test_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Copies with one change each are linked by the pivot; what differs too much from all is never paired."""
    r = random.Random(9)
    base, rows = [f"w{k}" for k in range(100)], []
    for i in range(300):
        words = list(base)
        for k in r.sample(range(96), 1 if i % 3 else 12):
            words[k] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    made, pairs = [], ngram_join._pairs

    def counted(*args):
        made.append(pairs(*args))
        return made[-1]

    monkeypatch.setattr(ngram_join, "_pairs", counted)
    got = ngram_join.near_duplicates(brute.table(spark, rows)).collect()
    assert as_text((x.doc_id, x.n_shingles, x.component_id) for x in got) == as_text(brute.near(rows))
    assert made and sum(x.count() for x in made) < 5 * len(rows)


def test_blocks_of_the_benchmark_copy_no_texts(spark, monkeypatch):
    """Three blocks and more: only hits are written; items without an id have an empty name."""
    words = [f"w{k}" for k in range(60)]
    items = [(None, " ".join(words[:20])), *((str(k), " ".join(words[k : k + 15])) for k in range(0, 40, 3))]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    rows = [(1, " ".join(words)), (1, " ".join(words)), (2, "none of them"), (3, None), (None, " ".join(words[5:25]))]
    docs = brute.table(spark, rows).withColumn("_t1", F.lit("clash")).withColumn("_spans", F.lit(1))
    written = []
    kept = decontamination.stored
    monkeypatch.setattr(decontamination, "stored", lambda df: written.append(df.columns) or kept(df))
    whole = decontamination.find_passages(docs, benchmark)
    assert written == []
    parts = decontamination.find_passages(docs, benchmark, block_bytes=200)
    assert len(written) >= 3 and all(c == ["_t1", "_t2", "spans", "items"] for c in written)
    assert parts.columns == whole.columns and as_text(map(tuple, parts.collect())) == as_text(map(tuple, whole.collect()))
    assert {r.found["items"][0] for r in whole.collect() if r.doc_id == 1} == {""}


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 31), (31, 30)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    found = {r.node: r.component for r in components.components(df).collect()}
    assert found == {i: 0 for i in range(21)} | {30: 30, 31: 30}


def test_fm_index():
    r = random.Random(1)
    for _ in range(120):
        n, k = r.randint(1, 80), r.randint(1, 5)
        s = [r.randrange(k) for _ in range(n)]
        index = fm_index.FmIndex(np.array(s), k)
        phrases = [[r.randrange(k) for _ in range(r.randint(1, 4))] for _ in range(10)]
        array, lengths = np.zeros((10, 4), np.int64), np.array([len(p) for p in phrases])
        for row, p in zip(array, phrases):
            row[: len(p)] = p
        for p, low, high in zip(phrases, *index.search(array, lengths)):
            places = sorted(index.locate(np.arange(low, high)).tolist())
            assert places == [i for i in range(n - len(p) + 1) if s[i : i + len(p)] == p]


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 60, "shard_words": 10}])
def test_decontamination(spark, sizes):
    r = random.Random(2)
    voc = ["a", "B", "é1", "zz", "q'x", "É"]
    mixed = lambda n: " ".join(r.choice(voc) for _ in range(n))
    items = [(i, mixed(r.randint(0, 9))) for i in range(5)] + [(7, None), (8, "")]
    rows = [(i, mixed(r.randint(0, 60))) for i in range(30)] + brute.odd_rows()
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = brute.table(spark, rows)
    found = decontamination.find_passages(docs, benchmark, 4, **sizes)
    assert found.columns == [*[c for c in docs.columns if c != "found"], "found"]
    got = found.select("doc_id", *[c.alias(n) for n, c in decontamination.hit_columns("found").items()])
    assert as_text(tuple(x) for x in got.collect()) == as_text(brute.hits(rows, items, 4))


def test_decontamination_without_documents_or_items(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = brute.table(spark, brute.odd_rows())
    assert decontamination.drop_contaminated(docs, none).count() == len(brute.odd_rows())
    assert decontamination.find_passages(brute.empty(spark), none).collect() == []


def test_passages_are_cut_out():
    text = "Keep this. One two THREE four, and this."
    (_, found, _), = decontamination.search_shard([pa.array([text])], decontamination.phrases([(1, "one two three four")], 13))
    (a, b), = decontamination.word_ranges(text, found)
    assert text[a:b] == "One two THREE four"


@pytest.mark.parametrize("law", sharding.LAWS)
def test_shards(spark, law):
    rows = [(i, "x" * (i * 37 % 400)) for i in range(500)] + [(900 + i, "the same text") for i in range(300)] + brute.odd_rows() + [(1, "x" * 37)] * 60
    got = sharding.shards(brute.table(spark, rows), 7, law, keys_per_range=4).collect()
    sizes = [len((t or "").encode()) + 16 for _, t in rows]
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, n) for (i, _), n in zip(rows, sizes))
    by_shard = {s: [r for r in got if r.shard == s] for s in range(7)}
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by_shard.values())
    if law == "rows":
        assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    else:
        totals = [sum(r.size for r in part) for part in by_shard.values()]
        assert max(totals) - min(totals) <= 2 * max(sizes)
    assert sharding.shards(brute.empty(spark), 3, law).collect() == []


def test_quality_counts(spark):
    rows = brute.odd_rows() + [(50, "one two three one two three\nb\nb\n b"), (51, "*** #a| <b>")]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows += [(1000 + i, t) for i, t in docs.items()]
    got = quality_rules.judged(brute.table(spark, rows)).collect()
    assert as_text((r.doc_id, *(r[c] for c in quality_rules.COUNTS), r.base_failed) for r in got) == as_text((i, *brute.counts(t)) for i, t in rows)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.judged(brute.empty(spark)).collect() == []


def test_quality_verdict_on_labels(spark):
    """No label is read by the rules: good documents stay, and nearly all bad ones go."""
    sf = "/root/testdata/sf0.01"
    judged = queries.QUERIES["op5_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = judged.filter("not base_failed").select("quality", "kept").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_label_model():
    none = dict.fromkeys(quality_rules.RULES)
    alone = [({**none, "symbols": 0}, 5), ({**none, "sentences": 1, "layout": 1}, 90), ({**none, "lines": 0, "sentences": 1, "layout": 1}, 5)]
    model = quality_rules.solve(alone)
    assert [model.odds(votes) > 0 for votes, _ in alone] == [False, True, True]
    assert model.accuracy["lines"] < 0.6 < 0.75 < model.accuracy["symbols"]
    assert quality_rules.solve([]).odds(none) == 0


def test_sketches_differ_in_no_more_bits_than_sets(spark):
    r = random.Random(12)
    rows, pairs = [], []
    for i in range(300):
        a = np.array([r.getrandbits(64) for _ in range(r.choice([1, 2, 16, 30, 33, 60, 64, 66, 500]))], np.uint64)
        b = np.concatenate((a[r.choice([0, 0, 1, len(a) // 12, len(a) // 3]) :], np.array([r.getrandbits(64) for _ in range(r.randint(0, 3))], np.uint64)))
        both = len(np.intersect1d(a, b))
        if len(b):
            rows += [(k, len(x), ngram_join.sketch(x).tolist()) for k, x in ((2 * i, a), (2 * i + 1, b))]
            pairs.append((2 * i, 2 * i + 1, 100 * both >= 85 * (len(a) + len(b) - both), both * 2 < len(a)))
    sketches = spark.createDataFrame(rows, "id int, n int, sketch array<bigint>")
    near = ngram_join._near(spark.createDataFrame(pairs, "a int, b int, similar boolean, far boolean"), sketches, 85)
    got = {(x.a, x.b) for x in near.collect()}
    assert {p[:2] for p in pairs if p[2]} <= got
    assert sum(p[:2] in got for p in pairs if p[3]) < sum(p[3] for p in pairs) / 10


def test_only_sets_that_may_be_similar_are_read(spark, monkeypatch):
    """Documents that share rare shingles, but not enough of all, cost no sets and no texts dealt out."""
    rows = [(i, " ".join([*(f"rare{i // 2}x{k}" for k in range(30)), *(f"own{i}x{k}" for k in range(70))])) for i in range(60)]
    rows += [(100 + i, " ".join(["alpha" if i and k == 50 else f"w{k}" for k in range(100)])) for i in range(2)]
    rows += [(None, "no id"), (None, rows[-1][1])]
    read, readers = [], ngram_join._readers

    def counted(*args):
        read.append(readers(*args))
        return read[-1]

    monkeypatch.setattr(ngram_join, "_readers", counted)
    got = ngram_join.near_duplicates(brute.table(spark, rows)).collect()
    assert as_text((x.doc_id, x.n_shingles, x.component_id) for x in got) == as_text(brute.near(rows))
    assert sum(x.count() for x in read) <= 4


def test_rows_of_a_class_meet_its_label_as_one(spark):
    one = [(t, {"c": 1, "c2": 1}, 9, t) for t in range(5)] + [(7, {"c": 2, "c2": 2}, 8, 3)]
    rows = spark.createDataFrame(one, "token bigint, id struct<c:bigint,c2:bigint>, n int, reach int")
    labels = spark.createDataFrame([({"c": 2, "c2": 2}, {"c": 0, "c2": 0})], "node struct<c:bigint,c2:bigint>, component struct<c:bigint,c2:bigint>")
    named = ngram_join._named(rows, labels)
    assert sorted((x.token, x.n, x.reach, x.comp.c) for x in named.collect()) == [(0, 9, 0, 1), (1, 9, 1, 1), (2, 9, 2, 1), (3, 9, 3, 1), (4, 9, 4, 1), (7, 8, 3, 0)]


def test_readers_are_found_by_bits(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(-500, 500)] + [(None, "t")], "doc_id bigint, text string")
    readers = spark.createDataFrame([(i,) for i in (-500, -7, 0, 1, 255, 499, None)], "reader bigint")
    assert sorted(x.text for x in ngram_join._readers(docs, readers).collect()) == ["t", "t-500", "t-7", "t0", "t1", "t255", "t499"]


def test_rounds_without_a_link_end_soon(spark, monkeypatch):
    """One n-gram of many classes that are not similar: pivots find nothing, so that few rounds are made."""
    rounds, counted = [], ngram_join._open_pairs
    monkeypatch.setattr(ngram_join, "_open_pairs", lambda rows: rounds.append(1) or counted(rows))
    grams = spark.createDataFrame([(7, {"c": i, "c2": i}, 100, 100) for i in range(40)], "token bigint, id struct<c:bigint,c2:bigint>, n int, reach int")
    sketches = grams.select("id", "n", F.array(F.hash("id").cast("bigint"), *[F.xxhash64("id", F.lit(k)) for k in range(3)]).alias("sketch"))
    assert ngram_join.similar_classes(grams, sketches, lambda wanted: None, 85, 1, 8) is None
    assert len(rounds) <= 4
