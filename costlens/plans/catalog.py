"""Registered queries: one per operator of the inventory, each with its
DuckDB twin where one exists.

A query is a function ``(spark, sf_dir) -> DataFrame`` that reads the
driver tables through ``costlens.sources`` and runs the library's own
operators over the whole tables. ``SQL[name]`` holds the oracle text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from costlens.plans import (  # noqa: F401
        q_ingest, q_detect, q_windows, q_eval, q_forecast, q_serve, q_rca, q_models, q_io)
