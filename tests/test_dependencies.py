"""Levels, cycles and bounded ranking against plain versions."""

from __future__ import annotations

import random
from functools import cache

import pytest

from custlytics.operators import corpus, dependencies, ranking
from custlytics.operators.dependencies import dependency_cycles, elimination, inner_calls

FUNCTIONS, CALLS = "script_id bigint, function_name string", "script_id bigint, function_name string, depends_on string"


def frames(spark, graphs):
    functions = [(s, f) for s, (names, _) in graphs.items() for f in names]
    calls = [(s, a, b) for s, (_, edges) in graphs.items() for a, b in edges]
    return spark.createDataFrame(functions, FUNCTIONS), spark.createDataFrame(calls, CALLS)


def plain(names, edges):
    needs = {n: {b for a, b in edges if a == n and b != n and b in names} for n in names}
    reach = {n: set() for n in names}
    for n in names:
        todo = list(needs[n])
        while todo:
            x = todo.pop()
            if x not in reach[n]:
                reach[n].add(x)
                todo += needs[x]
    on = {n for n in names if n in reach[n]}

    @cache
    def level(n):
        return max((level(b) + 1 for b in needs[n]), default=0)

    out = []
    for n in names:
        cycle = min(x for x in reach[n] if n in reach[x]) if n in on else None
        behind = n not in on and bool(reach[n] & on)
        out.append((n, None if cycle or behind else level(n), cycle, behind))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_cycles(spark, seed):
    r = random.Random(seed)
    graphs = {}
    for s in range(12):
        names = [f"f{i:02d}" for i in range(r.choice([1, 3, 8, 15]))]
        edges = [(r.choice(names), r.choice([*names, "outside"])) for _ in range(r.randint(0, int(len(names) * 1.3)))]
        graphs[s] = (names, edges)
    ring = [f"r{i:02d}" for i in range(30)]
    graphs[50] = (ring + ["way", "end", "x", "y"], [*zip(ring, ring[1:] + ring[:1], strict=True), ("way", "r03"), ("r05", "end"), ("x", "y"), ("y", "x"), ("r09", "x")])
    found = dependency_cycles(*frames(spark, graphs)).collect()
    for s, (names, edges) in graphs.items():
        assert sorted((r.function_name, r.level, r.cycle_id, r.behind) for r in found if r.script_id == s) == plain(names, edges)


def test_a_long_chain_takes_few_rounds(spark):
    names = [f"f{i:04d}" for i in range(1000)]
    functions, calls = frames(spark, {1: (names, list(zip(names[1:], names, strict=False)))})
    levels, rounds = elimination(functions, calls)
    assert rounds <= 20 and {r.function_name: r.level for r in levels.collect()} == {n: i for i, n in enumerate(names)}


def test_wide_needs(spark):
    names = [f"f{i:02d}" for i in range(40)]
    edges = [(a, b) for a in names for b in names if b < a]
    functions, calls = frames(spark, {1: (names, edges)})
    levels = elimination(functions, inner_calls(functions, calls), few=2, width=3)[0]
    assert {r.function_name: r.level for r in levels.collect()} == {n: i for i, n in enumerate(names)}


def test_no_functions(spark):
    functions, calls = frames(spark, {})
    assert dependency_cycles(functions, calls).collect() == [] and dependencies.elimination(functions, calls)[1] == 0


@pytest.mark.parametrize("probed", [1, 30])
@pytest.mark.parametrize("automaton", [True, False])
def test_bounded_ranking(spark, monkeypatch, probed, automaton):
    """Many recipes, small probes and close bounds: the best ones are still those of scoring everything."""
    r = random.Random(probed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    recipes = [(f"r{i}", i, " ".join(r.choices(words, weights, k=r.randint(1, 40))), None) for i in range(300)]
    recipes += [(f"s{i}", 300 + i, recipes[0][2], None) for i in range(20)]
    requests = [(i, r.choices(words, k=r.randint(1, 30))) for i in range(20)]
    monkeypatch.setattr(ranking, "PROBED_PER_RANK", 1)
    monkeypatch.setattr(ranking.best_groups, "__defaults__", (probed,))
    monkeypatch.setattr(ranking.recipe_keywords, "__defaults__", (ranking.AUTOMATON_CHARACTERS if automaton else 0,))
    frame = spark.createDataFrame(recipes, "id string, place int, description string, usage_context string")
    ranked = corpus.rank_recipes(spark.createDataFrame(requests, "request_id int, functions array<string>"), frame, 5).collect()
    for request, functions in requests:
        scores = sorted((-sum(f in f"{text} {i}" for f in functions), place, i) for i, place, text, _ in recipes)
        best = [(i, -score) for score, _, i in scores[:5] if score]
        assert [(x.id, x.score) for x in sorted((x for x in ranked if x.request_id == request), key=lambda x: x.rank)] == best
