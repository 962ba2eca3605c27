"""Derive the four raw domain tables from the benchmark tables.

Entity = supplier (one postal area per supplier); common dimension = supplier x nation x region.
Every panel is aggregated from ``lineitem`` *before* it meets the dimension, so the big side is
pre-aggregated (partial + final hash aggregate) and only (area, month) cells are joined.

Every line takes part in every table; the models' own filters drop what they should. A month without
a returned line has a null rent, a part type without a category a null category, and school years run
over all ship years, so the staging filters and the year slice of the school model have work to do.
The last month is incomplete, so some areas have no current value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areascope.functions.keys import pad_zip
from areascope.functions.numeric import safe_div, tie_safe_round
from areascope.sources.ingest import derive_school_ratios
from areascope.sources.tables import read_table

# Category of a part type, school year of a ship year (1996 is 2017, 2001 is 2022),
# supplier numbers that share the cities of all nations, so a city has some areas and cities grow with the suppliers.
PART_TYPE_CATEGORY = {"ECONOMY": "parks", "SMALL": "shopping", "MEDIUM": "entertainment", "LARGE": "dining"}
SCHOOL_YEAR_SHIFT = 21
SUPPLIERS_PER_CITY = 100


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier with its area attributes (postal code, city, state, metro...)."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = n.join(r, n.n_regionkey == r.r_regionkey)
    return s.join(geo, s.s_nationkey == geo.n_nationkey).select(
        F.col("s_suppkey"),
        pad_zip(F.col("s_suppkey")).alias("zip_code"),
        F.concat_ws(" ", F.col("n_name"), F.floor(F.col("s_suppkey") / SUPPLIERS_PER_CITY).cast("string")).alias("city"),
        F.concat(F.lit("C"), F.col("s_nationkey").cast("string")).alias("county"),
        F.col("n_name").alias("state"),
        F.col("n_name").alias("state_name"),
        F.when(F.col("s_suppkey") % 20 == 19, F.lit(None).cast("string")).otherwise(F.col("r_name")).alias("metro"),
        F.col("s_suppkey").cast("int").alias("region_id"),
        (F.col("s_suppkey") % 7).cast("int").alias("size_rank"),
    )


def _panel(cells: DataFrame, dim: DataFrame, value_name: str) -> DataFrame:
    return cells.join(dim, cells.l_suppkey == dim.s_suppkey).select(
        "region_id", "size_rank", "zip_code", F.lit("zip").alias("region_type"), "state_name", "state",
        "city", "metro", "county", "date", value_name,
    )


def monthly_cells(spark: SparkSession, sf_dir: str, key: str = "l_suppkey") -> DataFrame:
    """(area, month): value = 100000 + 3 * avg unit price, rent = 100 + 10000 * avg tax of the returned
    lines (null without one), both to cents. One scan and one aggregate serve both panels."""
    lines = read_table(spark, sf_dir, "lineitem")
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    return lines.groupBy(F.col(key).alias("l_suppkey"), month.alias("date")).agg(
        F.avg(safe_div(F.col("l_extendedprice"), F.col("l_quantity"))).alias("_unit"),
        F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_tax"))).alias("_tax"),
    ).select("l_suppkey", "date",
             tie_safe_round(F.lit(100000.0) + F.lit(3.0) * F.col("_unit"), 2).alias("home_value"),
             tie_safe_round(F.lit(100.0) + F.lit(10000.0) * F.col("_tax"), 2).alias("rental_price"))


def raw_home_values(spark: SparkSession, sf_dir: str, dim: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Monthly value panel, one row per (area, month)."""
    dim = dimension(spark, sf_dir) if dim is None else dim
    cells = monthly_cells(spark, sf_dir) if cells is None else cells
    return _panel(cells, dim, "home_value")


def sparse_value_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value panel keyed by part instead of supplier: few lines per (area, month), so most
    lookbacks find nothing. Columns: zip_code, date (date), home_value."""
    cells = monthly_cells(spark, sf_dir, "l_partkey")
    return cells.select(pad_zip(F.col("l_suppkey")).alias("zip_code"), "date", "home_value")


def last_month(spark: SparkSession, sf_dir: str) -> Column:
    """The latest month of the panels as a literal, from the ship dates alone (no aggregation by area)."""
    value = read_table(spark, sf_dir, "lineitem").agg(F.trunc(F.max(F.col("l_shipdate").cast("date")), "month")).first()[0]
    return F.lit(value).cast("date")


def raw_rental_prices(spark: SparkSession, sf_dir: str, dim: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Monthly rent panel; the rent is null in a month without a returned line."""
    dim = dimension(spark, sf_dir) if dim is None else dim
    cells = monthly_cells(spark, sf_dir) if cells is None else cells
    return _panel(cells, dim, "rental_price")


def raw_amenities(spark: SparkSession, sf_dir: str, dim: DataFrame | None = None) -> DataFrame:
    """One amenity per line; the category comes from the part type (null for the other types)."""
    dim = dimension(spark, sf_dir) if dim is None else dim
    lines = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    category = None
    for ptype, cat in PART_TYPE_CATEGORY.items():
        cond = F.col("p_type") == ptype
        category = F.when(cond, F.lit(cat)) if category is None else category.when(cond, F.lit(cat))
    joined = lines.join(part, lines.l_partkey == part.p_partkey).join(dim, F.col("l_suppkey") == dim.s_suppkey)
    return joined.select(
        "zip_code",
        F.col("p_name").alias("amenity_name"),
        F.col("p_brand").alias("amenity_type"),
        category.alias("amenity_category"),
        F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"),
        "city",
        "state_name",
    )


def raw_schools(spark: SparkSession, sf_dir: str, dim: DataFrame | None = None) -> DataFrame:
    """One school per line, in the school year of its ship year. The years are brought together (for a table with a folder for each)
    while a line is its numbers alone: names and areas join it after that shuffle."""
    dim = dimension(spark, sf_dir) if dim is None else dim
    lines = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag",
        (F.year("l_shipdate") + SCHOOL_YEAR_SHIFT).cast("int").alias("year")).hint("rebalance", "year")
    joined = lines.join(dim, lines.l_suppkey == dim.s_suppkey)
    school_id = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    raw = joined.select(
        school_id.alias("nces_school_id"),
        F.concat(F.lit("School "), school_id).alias("school_name"),
        "zip_code",
        "city",
        "state",
        F.col("l_linenumber").alias("school_level"),
        F.col("l_quantity").cast("int").alias("enrollment"),
        (F.col("l_tax") * 100).alias("teachers_fte"),
        F.floor(F.col("l_quantity") * F.col("l_discount")).cast("int").alias("free_lunch"),
        (F.col("l_returnflag") == "A").cast("int").alias("charter"),
        (F.col("l_returnflag") == "R").cast("int").alias("magnet"),
        (F.col("l_discount") > 0.05).cast("int").alias("title_i"),
        F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"),
        "year",
    )
    return derive_school_ratios(raw)
