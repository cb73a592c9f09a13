"""Large groups must give the same rows as plain windows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from custlytics.operators import joins, windows
from custlytics.operators.ordered import ordered_columns
from custlytics.operators.quantiles import quantiles


def skewed_rows(seed: int, n: int = 300):
    """Group a holds about half of the rows; values repeat a lot, some are null, one group is null."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        group = draw.choice(["a", "a", "a", "b", "c", None])
        value = draw.choice([None, 1.0, 1.0, 1.0, 2.0, 3.5, float(draw.randint(0, 20))])
        rows.append((group, value, i, float(draw.randint(-9, 9)) if draw.random() > 0.1 else None))
    return rows


SCHEMA = "grp string, value double, id int, amount double"
RUNNING = {
    "rn": "row_number",
    "rk": "rank",
    "dr": "dense_rank",
    "tile": ("ntile", 7),
    "total": ("sum", "amount"),
}
FRAMED = {
    "previous": lambda w: F.lag("amount", 2).over(w),
    "following": lambda w: F.lead("amount").over(w),
    "moving": lambda w: F.avg("amount").over(w.rowsBetween(-4, 0)),
    "ahead": lambda w: F.collect_list("id").over(w.rowsBetween(1, 3)),
}


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("order", [["value"], ["-value"]])
def test_split_groups_equal_plain_windows(spark, seed, order):
    df = spark.createDataFrame(skewed_rows(seed), SCHEMA).repartition(3)
    for by, limit in ((["grp"], 40), (["grp"], 9), ([], 50)):
        options = dict(ties=["id"], running=RUNNING, framed=FRAMED, before=4, after=3)
        plain = ordered_columns(df, by, order, **options)
        split = ordered_columns(df, by, order, **options, max_group_rows=limit)
        assert plain.columns == split.columns
        key = lambda row: row["id"]
        expected, found = sorted(plain.collect(), key=key), sorted(split.collect(), key=key)
        assert len(expected) == len(found) == 300
        for a, b in zip(expected, found, strict=True):
            assert [x for x in a if not isinstance(x, float)] == [x for x in b if not isinstance(x, float)]
            assert [x for x in a if isinstance(x, float)] == pytest.approx([x for x in b if isinstance(x, float)])


@pytest.mark.parametrize("discrete", [False, True])
def test_counted_quantiles_equal_builtin(spark, discrete):
    df = spark.createDataFrame(skewed_rows(5), SCHEMA)
    wanted = [0.0, 0.1, 0.25, 0.5, 0.8, 0.99, 1.0]
    for by in ([], ["grp"]):
        plain = quantiles(df, ["value", "amount"], wanted, by, discrete=discrete).collect()
        split = quantiles(df, ["value", "amount"], wanted, by, discrete=discrete, max_group_rows=8).collect()
        order = lambda row: str(row[0]) if by else ""
        for a, b in zip(sorted(plain, key=order), sorted(split, key=order), strict=True):
            assert a["value"] == pytest.approx(b["value"])
            assert a["amount"] == pytest.approx(b["amount"])


@pytest.mark.parametrize("seed", range(4))
def test_closest_incomes_equal_brute_force(spark, seed):
    draw = random.Random(seed)
    spread = [40, 4000, 100000][seed % 3]
    people = [(i, draw.choice("xxy"), float(draw.randint(0, spread))) for i in draw.sample(range(500), 120)]
    people += [(900, "x", None), (901, None, 5.0), (902, None, 5.0)]
    pairs = [
        (abs(a[2] - b[2]), a[0], b[0])
        for a in people
        for b in people
        if a[0] != b[0] and a[1] is not None and a[1] == b[1] and None not in (a[2], b[2]) and abs(a[2] - b[2]) < 5000
    ]
    df = spark.createDataFrame(people, "customer_id int, region string, income double")
    for limit in (3, 20):
        for group_rows in (2_000_000, 30):
            found = joins.closest_incomes(df, limit, max_group_rows=group_rows).collect()
            assert [(r.gap, r.customer1, r.customer2) for r in found] == sorted(pairs)[:limit]


def test_rolling_needs_full_windows_without_nulls(spark):
    rows = [(i, None if i in (3, 17) else float(i * i % 11)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, x double").repartition(4)
    for group_rows in (2_000_000, 7):
        spec = {"mean": ("x", "mean", 5), "total": ("x", "sum", 3)}
        found = {r.id: r for r in windows.rolling(df, "id", spec, max_group_rows=group_rows).collect()}
        assert len(found) == 40
        for i in range(40):
            for name, width, scale in (("mean", 5, 5), ("total", 3, 1)):
                values = [rows[j][1] for j in range(i - width + 1, i + 1) if j >= 0]
                full = len(values) == width and None not in values
                expected = pytest.approx(sum(values) / scale) if full else None
                assert found[i][name] == expected


def test_rank_first_last_on_split_groups(spark):
    df = spark.createDataFrame(skewed_rows(8), SCHEMA)
    whole = windows.rank_first_last(df, "grp", "value", "id")
    split = windows.rank_first_last(df, "grp", "value", "id", max_group_rows=11)
    assert sorted(map(str, whole.collect())) == sorted(map(str, split.collect()))
