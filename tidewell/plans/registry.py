"""Registry of runnable queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.bindings import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, plan: Callable[[Tables], DataFrame], sql: str | None = None, views: str = "") -> None:
    """Register ``plan`` under ``name``; ``sql`` is its body over ``views``."""
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = lambda spark, folder: plan(Tables(spark, folder))
    if sql is not None:
        SQL[name] = with_views(views, sql)


def q4(expression: str) -> str:
    """SQL twin of ``functions.numeric.r4``."""
    return f"floor(({expression}) * 1e4 + 5000001e-7) / 1e4"


def q9(expression: str) -> str:
    return f"floor(({expression}) * 1e9 + 501e-3) / 1e9"
