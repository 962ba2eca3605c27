"""Layer materialisation (the project build) and loading stored marts.

Staging and intermediate models are registered as temp views (lazy; Catalyst inlines them); marts
and raw tables are catalog tables of a schema, built in dependency order. Independent raw tables
are written by concurrent jobs so the cluster is not idle while one scan finishes.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from areascope.plans.layers import Layers
from areascope.session import Stored, store
from areascope.sources.ingest import ensure_schema

STAGING_VIEWS = ("stg_home_values", "stg_rental_prices", "stg_amenities", "stg_schools")
INTERMEDIATE_VIEWS = {"int_price_trends": "price_trends", "int_rental_yield": "rental_yield",
                      "int_neighborhood_score": "neighborhood_score", "int_school_score": "school_score"}
MARTS = ("market_intelligence", "investment_hotspots", "area_comparison")
RAW = ("raw_home_values", "raw_rental_prices", "raw_amenities", "raw_schools")


def build_raw_layer(layers: Layers, parallelism: int = 4) -> None:
    """Write the four raw tables with concurrent jobs (they share only the area dimension, which is
    built first)."""
    getattr(layers, "area_dimension", None)
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        list(pool.map(lambda name: getattr(layers, name), RAW))


def register_views(layers: Layers) -> None:
    """Staging and intermediate layers as temp views (``spark.sql`` can query them by name)."""
    for name in STAGING_VIEWS:
        getattr(layers, name).createOrReplaceTempView(name)
    for view, attr in INTERMEDIATE_VIEWS.items():
        getattr(layers, attr).createOrReplaceTempView(view)


def build(layers: Layers, schema: str) -> dict[str, DataFrame]:
    """Build every layer: raw tables, views, then marts in dependency order. Raw tables and marts are
    catalog tables ``<schema>.<name>`` over the files that the layers have stored, so nothing is
    written twice. Returns the marts, read back by name."""
    spark = layers.spark
    ensure_schema(spark, schema)
    build_raw_layer(layers)
    register_views(layers)
    for name in (*RAW, *MARTS):
        df = getattr(layers, name)
        kept = layers.stored.get(name) or store(df, name)      # raw tables that were handed in are not stored yet
        register_table(spark, kept, f"{schema}.{name}")
    return {name: load_mart(spark, schema, name) for name in MARTS}


def register_table(spark: SparkSession, kept: Stored, name: str) -> None:
    """Make the files of a stored table a catalog table of this name (replacing an earlier one)."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.catalog.createTable(name, path=kept.path, source="parquet")
    if spark.catalog.listColumns(name) and any(c.isPartition for c in spark.catalog.listColumns(name)):
        spark.catalog.recoverPartitions(name)


def load_mart(spark: SparkSession, schema: str, name: str) -> DataFrame:
    """Read a stored mart by name (filters on it are pushed into the parquet scan)."""
    return spark.table(f"{schema}.{name}")
