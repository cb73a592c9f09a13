"""Conditional columns built from threshold tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from custlytics.functions import fixed_values as fixed


def _first_true(cases: Sequence[tuple[Column, object]], otherwise) -> Column:
    if not cases:
        return F.lit(otherwise)
    (test, value), *rest = cases
    chain = reduce(lambda acc, case: acc.when(case[0], F.lit(case[1])), rest, F.when(test, F.lit(value)))
    return chain if otherwise is None else chain.otherwise(F.lit(otherwise))


def below(value: Column, steps, otherwise) -> Column:
    """Label of the first step whose bound lies above ``value``; null falls to ``otherwise``."""
    return _first_true([(value < bound, label) for bound, label in steps], otherwise)


def above(value: Column, steps, otherwise) -> Column:
    """Label of the first step whose bound lies below ``value``; null falls to ``otherwise``."""
    return _first_true([(value > bound, label) for bound, label in steps], otherwise)


def at_most(value: Column, steps, otherwise) -> Column:
    return _first_true([(value <= bound, label) for bound, label in steps], otherwise)


def at_least(value: Column, steps, otherwise) -> Column:
    return _first_true([(value >= bound, label) for bound, label in steps], otherwise)


def age_group(age: Column, steps=fixed.AGE_GROUPS_CLEANING) -> Column:
    return below(age, steps, fixed.AGE_GROUP_OTHER)


def income_bracket(income: Column) -> Column:
    return below(income, fixed.INCOME_BRACKETS, fixed.INCOME_BRACKET_OTHER)


def customer_tier(total: Column, tiers=fixed.CUSTOMER_TIERS) -> Column:
    return above(total, tiers, fixed.CUSTOMER_TIER_OTHER)


def risk_score(credit_score: Column) -> Column:
    return above(credit_score, fixed.RISK_SCORES, fixed.RISK_SCORE_OTHER)


def customer_segment(income: Column, credit_score: Column, segments=fixed.CUSTOMER_SEGMENTS) -> Column:
    cases = [((income > rich) & (credit_score > score), label) for rich, score, label in segments]
    return _first_true(cases, fixed.CUSTOMER_SEGMENT_OTHER)


def cut(value: Column, edges: Sequence[float], labels: Sequence[str], *, lowest_included=False) -> Column:
    """Right-closed bins ``(edge, next edge]``; values outside all bins become null."""
    cases = []
    for place, (low, high, label) in enumerate(zip(edges, edges[1:], labels, strict=False)):
        over = value >= low if lowest_included and place == 0 else value > low
        cases.append((over & (value <= high), label))
    return _first_true(cases, None)


def clip(value: Column, low: Column, high: Column) -> Column:
    """Limit to ``[low, high]``; null stays null."""
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def ordinal_code(value: Column, codes: Mapping[str, int]) -> Column:
    """Code of each label; unknown labels become null."""
    return _first_true([(value == label, code) for label, code in codes.items()], None)
