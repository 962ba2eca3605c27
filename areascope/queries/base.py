"""Query registration and the per-session model layers the queries share.

Every query reads the benchmark tables (through the adapter) in full. The raw layer is written
once per (session, folder) - the reference also lands raw tables before modelling - and the layers
above it are built on first use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from areascope import oracle as O
from areascope.plans.layers import Layers

_LAYERS: dict[tuple[int, str], Layers] = {}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def layers(spark: SparkSession, sf_dir: str) -> Layers:
    """The model layers over one benchmark folder, shared by every query of a session."""
    key = (id(spark), sf_dir.rstrip("/"))
    cached = _LAYERS.get(key)
    if cached is None or cached.spark is not spark:   # ids can be reused after a session is gone
        cached = _LAYERS[key] = Layers.from_benchmark(spark, sf_dir)
    return cached


def register(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame query and its DuckDB oracle SQL."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def select_all(table: str) -> str:
    """Oracle SQL selecting a whole model CTE."""
    return O.with_models(f"SELECT * FROM {table}")
