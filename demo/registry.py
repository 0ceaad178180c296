"""Registry of runnable queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierline.session import tune

from .views import Views, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: CTEs of derived results that several oracles share.
SHARED: dict[str, str] = {}

_views: dict[tuple[str, str], Views] = {}


def views(spark: SparkSession, sf_dir: str) -> Views:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _views:
        _views[key] = Views(tune(spark), sf_dir)
    return _views[key]


def query(name: str, oracle: str | None = None):
    """Register ``fn(views) -> DataFrame`` under a name, with its oracle."""

    def add(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(views(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def oracle_texts() -> dict[str, str]:
    return {name: with_ctes(sql, SHARED) for name, sql in ORACLES.items()}
