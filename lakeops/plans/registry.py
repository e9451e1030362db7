"""``query(name, sql)`` registers a Spark query next to its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeops.plans.lake import Lake, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(lake) -> DataFrame`` under ``name``; ``sql`` may name ``fx_*`` views."""

    def wrap(fn: Callable[[Lake], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        run = lambda spark, sf_dir: fn(Lake(spark, sf_dir))
        run.src = fn.__module__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return wrap
