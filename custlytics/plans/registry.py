"""Collects the registered queries of the ``plans`` modules."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    oracle: str | None


_QUERIES: dict[str, Query] = {}


def query(oracle: str | None) -> Callable[[Plan], Plan]:
    """Register the decorated function under its own name."""

    def register(plan: Plan) -> Plan:
        if plan.__name__ in _QUERIES:
            raise ValueError(f"query registered twice: {plan.__name__}")
        _QUERIES[plan.__name__] = Query(plan.__name__, plan, oracle)
        return plan

    return register


def registered(name: str) -> Query:
    return _QUERIES[name]


def all_queries() -> dict[str, Query]:
    package = importlib.import_module("custlytics.plans")
    for module in pkgutil.iter_modules(package.__path__):
        importlib.import_module(f"custlytics.plans.{module.name}")
    return dict(_QUERIES)


def rounded(name: str, digits: int = 4) -> Column:
    """A double column rounded for comparison: sums of doubles depend on their order."""
    return F.round(F.col(name), digits).alias(name)


def day(name: str) -> Column:
    return F.col(name).cast("string").alias(name)
