"""Registry of the queries: a callable over a table folder, and DuckDB text where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import shared
from .views import view, with_views

__all__ = ["ORACLES", "QUERIES", "query", "shared"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None) -> Callable:
    """Register ``f(*views)``; functions of no views get the session and folder."""

    def register(f: Callable) -> Callable:
        QUERIES[name] = (lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])) if views else f
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return f

    return register
