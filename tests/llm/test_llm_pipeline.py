"""The stages of the pipeline and the whole of it against plain versions."""

from __future__ import annotations

import brute
import corpus_pipeline
import numpy as np

import __spark_entry__ as entry_points
from custlytics.llm import quality_rules, tokens

SF = "/root/testdata/sf0.001"


def plain_run(docs, votes, items):
    """(doc_id, text) after each stage."""
    patterns = {}
    for v in votes.values():
        patterns[tuple(v.items())] = patterns.get(tuple(v.items()), 0) + 1
    model = quality_rules.solve([(dict(k), n) for k, n in patterns.items()])
    kept = [(i, t) for i, t in docs if not brute.counts(t)[-1] and model.odds(votes[i]) >= 0]
    yield kept
    lines = brute.line_dedup(kept, 10, True)
    kept = [(i, t) for i, _, n, t in lines if not n or t.split()]
    yield kept
    kept = [(i, t) for (i, t), (_, _, c) in zip(kept, brute.near(kept)) if c == i]
    yield kept
    kept = [(i, t) for (i, t), h in zip(kept, brute.hits(kept, items)) if not h[-1]]
    yield kept


def test_pipeline_equals_a_plain_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counted = quality_rules.with_votes(quality_rules.with_counts(docs)).select("doc.doc_id", "votes").collect()
    votes = {r.doc_id: r.votes.asDict() for r in counted}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    *_, wanted = plain_run(rows, votes, items)
    encode = tokens.load().encode
    sizes = {i: len(encode(t, add_special_tokens=False).ids) + 1 for i, t in wanted}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.doc_tokens for r in pieces} == sizes
    assert sum(r.length for r in pieces) == sum(sizes.values())
    fill = np.bincount(np.unique([r.sequence_id for r in pieces], return_inverse=True)[1], [r.length for r in pieces])
    assert fill.max() <= 2048


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_queries_are_registered():
    names = [n for n in entry_points.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry_points.queries() and [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"
