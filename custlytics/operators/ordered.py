"""Ordered window columns that stay even when one group holds a large share of all rows.

A plain window sends each group to one task. That is right while groups are small, and it is what
happens here for every group of at most ``max_group_rows`` rows. Larger groups are laid out in range
partitions over (group, order) instead, so that no task gets more than about that many rows:

* running columns (row number, ranks, n-tiles, running sums, a group's first and last value) are computed
  inside each block and completed from what the other blocks hold; the block table has one row per
  block and group;
* frame columns (lag, lead, moving aggregates) get each block with the few rows around it that its
  frames reach into.

Both ways give the same rows and the same types (positions are 64-bit). One aggregate over the group keys
decides between them; split rows are checkpointed first, so that they are computed once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from custlytics.session import checkpointed

#: Rows of one group that a task may hold, unless :func:`limited_groups` sets another number.
MAX_GROUP_ROWS = 2_000_000
_limit: ContextVar[int] = ContextVar("max_group_rows", default=MAX_GROUP_ROWS)


@contextmanager
def limited_groups(rows: int) -> Iterator[None]:
    """Plans made inside split groups of more than ``rows`` rows, for wide rows or small executors."""
    token = _limit.set(rows)
    try:
        yield
    finally:
        _limit.reset(token)


def group_rows(given: int | None) -> int:
    return _limit.get() if given is None else given


Running = str | tuple
Framed = Callable[[WindowSpec], Column]


def sort_column(name: str) -> Column:
    """``"x"`` sorts ascending with nulls first, ``"-x"`` descending with nulls last."""
    return F.col(name[1:]).desc_nulls_last() if name.startswith("-") else F.col(name).asc_nulls_first()


def _column_name(name: str) -> str:
    return name.removeprefix("-")


def large_groups(df: DataFrame, by: Sequence[str], max_group_rows: int) -> DataFrame:
    """Groups above the limit; there can be at most (rows / max_group_rows) of them."""
    keys = [F.col(c).alias(f"_key_{c}") for c in by]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counted.filter(F.col("_rows") > max_group_rows)


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


def ordered_columns(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    ties: Sequence[str] = (),
    running: Mapping[str, Running] | None = None,
    framed: Mapping[str, Framed] | None = None,
    before: int = 0,
    after: int = 0,
    max_group_rows: int | None = None,
) -> DataFrame:
    """Add window columns over ``by`` groups sorted by ``order`` and then ``ties``.

    ``order + ties`` must be unique within a group. Rows equal in ``order`` share rank and dense rank.

    ``running`` maps a new column to ``"row_number"``, ``"rank"``, ``"dense_rank"``, ``("ntile", k)``,
    ``("sum", column)``, or ``("first", column)`` and ``("last", column)`` of the whole group; ``framed`` maps a new column to a function of a window, whose frame may reach
    ``before`` rows back and ``after`` rows ahead.
    """
    running, framed = dict(running or {}), dict(framed or {})
    max_group_rows = group_rows(max_group_rows)
    large = large_groups(df, by, max_group_rows)
    found = large.agg(F.count(F.lit(1)).alias("groups"), F.sum("_rows").alias("rows")).first()
    if not found["groups"]:
        return _plain(df, by, order, ties, running, framed)

    blocks = math.ceil(found["rows"] / max_group_rows)
    # Both parts and the layout read the rows: they are computed once.
    df = checkpointed(df)
    if not by:
        return _split(df, by, order, ties, running, framed, before, after, max_group_rows, blocks)
    large = checkpointed(large)
    is_large = _same(by, [f"_key_{c}" for c in by])
    small_part = _plain(df.join(large, is_large, "left_anti"), by, order, ties, running, framed)
    large_part = _split(
        df.join(large, is_large, "left_semi"), by, order, ties, running, framed, before, after, max_group_rows, blocks
    )
    return small_part.unionByName(large_part)


def _plain(df, by, order, ties, running, framed) -> DataFrame:
    whole = Window.partitionBy(*by).orderBy(*map(sort_column, [*order, *ties]))
    peers = Window.partitionBy(*by).orderBy(*map(sort_column, order))
    added = {}
    for name, kind in running.items():
        if kind == "row_number":
            added[name] = F.row_number().over(whole).cast("bigint")
        elif kind == "rank":
            added[name] = F.rank().over(peers).cast("bigint")
        elif kind == "dense_rank":
            added[name] = F.dense_rank().over(peers).cast("bigint")
        elif kind[0] == "ntile":
            added[name] = F.ntile(kind[1]).over(whole).cast("bigint")
        elif kind[0] == "sum":
            added[name] = F.sum(kind[1]).over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        elif kind[0] in ("first", "last"):
            end = F.first if kind[0] == "first" else F.last
            all_rows = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            added[name] = end(kind[1]).over(all_rows)
        else:
            raise ValueError(f"unknown running column: {kind}")
    added.update({name: build(whole) for name, build in framed.items()})
    return df.withColumns(added)


def _split(df, by, order, ties, running, framed, before, after, block_rows, blocks) -> DataFrame:
    total_order = [*order, *ties]
    laid_out = df.repartitionByRange(max(blocks, 2), *by, *map(sort_column, total_order))
    laid_out = checkpointed(laid_out.withColumn("_block", F.spark_partition_id()))

    in_block = Window.partitionBy("_block", *by).orderBy(*map(sort_column, total_order))
    peers = Window.partitionBy("_block", *by).orderBy(*map(sort_column, order))
    sums = {name: kind[1] for name, kind in running.items() if kind[0] == "sum"}
    ends = {name: kind for name, kind in running.items() if kind[0] in ("first", "last")}
    local = laid_out.withColumns(
        {
            "_number": F.row_number().over(in_block),
            "_rank": F.rank().over(peers),
            "_dense": F.dense_rank().over(peers),
            **{
                f"_sum_{name}": F.sum(source).over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow))
                for name, source in sums.items()
            },
        }
    )
    shifted = local.join(
        _block_offsets(local, by, order, sums, ends), _same(["_block", *by], ["_b", *[f"_key_{c}" for c in by]]), "inner"
    )

    position = F.col("_number") + F.col("_rows_before")
    added = {"_position": position}
    for name, kind in running.items():
        if kind == "row_number":
            added[name] = position.cast("bigint")
        elif kind == "rank":
            carried = F.col("_continues") & (F.col("_dense") == 1)
            rank = F.when(carried, F.col("_run_start")).otherwise(F.col("_rank") + F.col("_rows_before"))
            added[name] = rank.cast("bigint")
        elif kind == "dense_rank":
            added[name] = (F.col("_dense") + F.col("_values_before") - F.col("_continues").cast("int")).cast("bigint")
        elif kind[0] == "ntile":
            added[name] = _ntile(position, F.col("_group_rows"), kind[1])
        elif kind[0] == "sum":
            own, carried = F.col(f"_sum_{name}"), F.col(f"_before_{name}")
            added[name] = F.coalesce(own + carried, own, carried)
        elif kind[0] in ("first", "last"):
            added[name] = F.col(f"_end_{name}")
        else:
            raise ValueError(f"unknown running column: {kind}")
    result = shifted.withColumns(added)
    if framed:
        result = _with_frames(result, by, framed, before, after, max(block_rows, before, after))
    return result.select(*df.columns, *running, *framed)


def _block_offsets(local: DataFrame, by, order, sums, ends) -> DataFrame:
    """What lies before each block of a group: rows, distinct order values, sums, an open run of ties."""
    order_value = F.struct(*[F.col(_column_name(c)) for c in order])
    per_block = local.groupBy(F.col("_block").alias("_b"), *[F.col(c).alias(f"_key_{c}") for c in by]).agg(
        F.max("_number").cast("long").alias("_rows"),
        F.max("_rank").cast("long").alias("_last_run"),
        F.max("_dense").cast("long").alias("_values"),
        F.min_by(order_value, "_number").alias("_first"),
        F.max_by(order_value, "_number").alias("_last"),
        *[F.sum(source).alias(f"_total_{name}") for name, source in sums.items()],
        *[
            (F.min_by if end == "first" else F.max_by)(source, "_number").alias(f"_own_{name}")
            for name, (end, source) in ends.items()
        ],
    )
    group = Window.partitionBy(*[f"_key_{c}" for c in by])
    blocks = group.orderBy("_b")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    continues = F.coalesce(F.col("_first").eqNullSafe(F.lag("_last").over(blocks)), F.lit(False))
    per_block = per_block.withColumns(
        {
            "_continues": continues,
            "_rows_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
            "_group_rows": F.sum("_rows").over(group),
            **{f"_before_{name}": F.sum(f"_total_{name}").over(earlier) for name in sums},
            **{
                f"_end_{name}": (F.min_by if end == "first" else F.max_by)(f"_own_{name}", "_b").over(group)
                for name, (end, _) in ends.items()
            },
        }
    )
    opens_run = ~((F.col("_values") == 1) & F.col("_continues"))
    return per_block.select(
        "_b",
        *[f"_key_{c}" for c in by],
        "_continues",
        "_rows_before",
        "_group_rows",
        F.coalesce(F.sum(F.col("_values") - F.col("_continues").cast("int")).over(earlier), F.lit(0)).alias(
            "_values_before"
        ),
        F.last(F.when(opens_run, F.col("_rows_before") + F.col("_last_run")), ignorenulls=True)
        .over(earlier)
        .alias("_run_start"),
        *[f"_before_{name}" for name in sums],
        *[f"_end_{name}" for name in ends],
    )


def _ntile(position: Column, rows: Column, tiles: int) -> Column:
    """Tile of a 1-based position: the first ``rows % tiles`` tiles hold one row more."""
    small, longer = F.floor(rows / tiles), rows % tiles
    in_longer = longer * (small + 1)
    return (
        F.when(position <= in_longer, F.floor((position - 1) / (small + 1)) + 1)
        .otherwise(longer + F.floor(F.try_divide(position - 1 - in_longer, small)) + 1)
        .cast("bigint")
    )


def _with_frames(df: DataFrame, by, framed, before: int, after: int, block_rows: int) -> DataFrame:
    """Cut each group into stretches of ``block_rows`` positions and lend each its neighbours' edge rows."""
    place = F.col("_position") - 1
    stretch, inside = F.floor(place / block_rows), place % block_rows
    wanted = F.array_compact(
        F.array(
            stretch,
            F.when(inside >= block_rows - before, stretch + 1),
            F.when((inside < after) & (stretch > 0), stretch - 1),
        )
    )
    window = Window.partitionBy(*by, "_stretch").orderBy("_position")
    return (
        df.withColumn("_own", stretch)
        .withColumn("_stretch", F.explode(wanted))
        .withColumns({name: build(window) for name, build in framed.items()})
        .filter(F.col("_stretch") == F.col("_own"))
    )
