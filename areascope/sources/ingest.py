"""Ingestion: wide CSV panels, landed API JSON, lookups, raw-table writes and profiles.

The reference pulled everything through one driver (pandas melt, HTTP loops, ``createDataFrame``).
Here every step is a distributed read/transform: the CSV and the landed JSON pages are read by
executors, reshaped with ``unpivot`` / ``explode`` and written by executors. HTTP fetching is out of
scope (responses are expected as files landed by whatever fetches them).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areascope.functions.keys import header_date, pad_zip, school_zip, tag
from areascope.functions.labels import AMENITY_TAGS, classify_amenity
from areascope.functions.numeric import round_half_even, tie_safe_round
from areascope.operators.aggregates import count_by
from areascope.operators.hotjoin import expanding_join
from areascope.operators.reshape import rename_snake, split_columns, unpivot_panel

# Metadata columns of the wide panel files and their snake_case names.
PANEL_META_COLS = ("RegionID", "SizeRank", "RegionName", "RegionType", "StateName", "State", "City", "Metro", "CountyName")
PANEL_RENAMES = {
    "RegionID": "region_id",
    "SizeRank": "size_rank",
    "RegionName": "zip_code",
    "RegionType": "region_type",
    "StateName": "state_name",
    "State": "state",
    "City": "city",
    "Metro": "metro",
    "CountyName": "county",
}

# State abbreviation -> FIPS code (50 states + DC).
STATE_FIPS = {
    "AL": 1, "AK": 2, "AZ": 4, "AR": 5, "CA": 6, "CO": 8, "CT": 9, "DE": 10, "FL": 12,
    "GA": 13, "HI": 15, "ID": 16, "IL": 17, "IN": 18, "IA": 19, "KS": 20, "KY": 21,
    "LA": 22, "ME": 23, "MD": 24, "MA": 25, "MI": 26, "MN": 27, "MS": 28, "MO": 29,
    "MT": 30, "NE": 31, "NV": 32, "NH": 33, "NJ": 34, "NM": 35, "NY": 36, "NC": 37,
    "ND": 38, "OH": 39, "OK": 40, "OR": 41, "PA": 42, "RI": 44, "SC": 45, "SD": 46,
    "TN": 47, "TX": 48, "UT": 49, "VT": 50, "VA": 51, "WA": 53, "WV": 54, "WI": 55,
    "WY": 56, "DC": 11,
}
REGULAR_SCHOOL_TYPE = 1

AMENITY_RESPONSE_SCHEMA = T.StructType([
    T.StructField("city", T.StringType()),
    T.StructField("state_name", T.StringType()),
    T.StructField("elements", T.ArrayType(T.StructType([
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("center", T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]))),
])

SCHOOL_RECORD_SCHEMA = T.StructType([
    T.StructField("ncessch", T.StringType()),
    T.StructField("school_name", T.StringType()),
    T.StructField("zip_mailing", T.StringType()),
    T.StructField("zip_location", T.StringType()),
    T.StructField("city_location", T.StringType()),
    T.StructField("school_level", T.StringType()),
    T.StructField("school_type", T.IntegerType()),
    T.StructField("fips", T.IntegerType()),
    T.StructField("enrollment", T.DoubleType()),
    T.StructField("teachers_fte", T.DoubleType()),
    T.StructField("free_or_reduced_price_lunch", T.DoubleType()),
    T.StructField("charter", T.IntegerType()),
    T.StructField("magnet", T.IntegerType()),
    T.StructField("title_i_eligible", T.IntegerType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])

SCHOOL_PAGE_SCHEMA = T.StructType([
    T.StructField("state", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("next", T.StringType()),
    T.StructField("results", T.ArrayType(SCHOOL_RECORD_SCHEMA)),
])


# ---------------------------------------------------------------- wide panels (S-01..S-03, S-08)

def read_wide_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Read a wide panel CSV (header row; every column as string so ids keep leading zeros). All files must have the header of the first;
    one that differs ends the job (``releases.read_wide_releases`` reads each file by its own)."""
    return spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(path)


def wide_to_long(df: DataFrame, value_name: str, meta_cols: Sequence[str] = PANEL_META_COLS) -> DataFrame:
    """Melt month columns into (meta..., date, value), drop empty months, pad the postal code and
    rename to snake_case. Month columns are found dynamically: every non-metadata column."""
    ids, months = split_columns(df, meta_cols)
    long = unpivot_panel(df, ids, months, "date", value_name)
    long = long.withColumn("date", header_date(F.col("date")))
    if "RegionName" in long.columns:
        long = long.withColumn("RegionName", pad_zip(F.col("RegionName")))
    return rename_snake(long, PANEL_RENAMES)


# ---------------------------------------------------------------- landed API JSON (S-04..S-07)

def read_amenity_responses(spark: SparkSession, path: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """One response per file (``multi_line``) or one response per line (JSON Lines)."""
    return spark.read.schema(AMENITY_RESPONSE_SCHEMA).option("multiLine", multi_line).json(path)


def _tags(e: Column) -> list[Column]:
    """What the classification of an element needs, each tag looked up once."""
    t = e["tags"]
    return [
        tag(t, "name", "unnamed").alias("amenity_name"),
        *[t[key].alias(key) for key in AMENITY_TAGS],
        F.coalesce(e["lat"], e["center"]["lat"]).alias("latitude"),
        F.coalesce(e["lon"], e["center"]["lon"]).alias("longitude"),
    ]


def _amenity_columns(a: Column) -> list[Column]:
    category, kind = classify_amenity(a)
    return [a["amenity_name"].alias("amenity_name"), kind.alias("amenity_type"), category.alias("amenity_category"),
            a["latitude"].alias("latitude"), a["longitude"].alias("longitude")]


def flatten_amenity_json(responses: DataFrame) -> DataFrame:
    """One row per classified element: name (default 'unnamed'), type, category, coordinates from
    the element or its ``center``, and the request's city/state. Unclassified elements drop."""
    el = responses.select("city", "state_name", F.explode("elements").alias("e"))
    out = el.select(F.struct(*_tags(F.col("e"))).alias("a"), "city", "state_name").select(*_amenity_columns(F.col("a")), "city", "state_name")
    return out.where(F.col("amenity_category").isNotNull())


def classified_elements(elements: Column) -> Column:
    """The elements of one page that have a category, as an array of their names, tags and coordinates for ``flatten_classified``.
    Functions of an array are interpreted, so each tag is looked up once and the labels are left to the rows."""
    found = F.transform(elements, lambda e: F.struct(*_tags(e)))
    return F.filter(found, lambda a: classify_amenity(a)[0].isNotNull())


def flatten_classified(pages: DataFrame) -> DataFrame:
    """Pages with ``amenities`` (``classified_elements``) -> the rows of ``flatten_amenity_json``."""
    return pages.select("city", "state_name", F.explode("amenities").alias("a")).select(*_amenity_columns(F.col("a")), "city", "state_name")


def read_school_pages(spark: SparkSession, path: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """One page per file (``multi_line``) or one page per line (JSON Lines)."""
    return spark.read.schema(SCHOOL_PAGE_SCHEMA).option("multiLine", multi_line).json(path)


def flatten_school_json(pages: DataFrame) -> DataFrame:
    """One row per ``results[]`` record with the page's state and year attached."""
    rec = pages.select("state", "year", F.explode("results").alias("s"))
    return rec.select(
        F.coalesce(F.col("s.ncessch"), F.lit("")).alias("nces_school_id"),
        F.coalesce(F.col("s.school_name"), F.lit("")).alias("school_name"),
        school_zip(F.col("s.zip_mailing"), F.col("s.zip_location")).alias("zip_code"),
        F.coalesce(F.col("s.city_location"), F.lit("")).alias("city"),
        "state",
        F.col("s.school_level").alias("school_level"),
        F.col("s.enrollment").alias("enrollment"),
        F.col("s.teachers_fte").alias("teachers_fte"),
        F.col("s.free_or_reduced_price_lunch").alias("free_lunch"),
        F.coalesce(F.col("s.charter"), F.lit(0)).alias("charter"),
        F.coalesce(F.col("s.magnet"), F.lit(0)).alias("magnet"),
        F.coalesce(F.col("s.title_i_eligible"), F.lit(0)).alias("title_i"),
        F.col("s.latitude").alias("latitude"),
        F.col("s.longitude").alias("longitude"),
        "year",
        F.col("s.school_type").alias("school_type"),
        F.col("s.fips").alias("fips"),
    )


def union_years(*frames: DataFrame) -> DataFrame:
    """Concatenate school records fetched for different years (by column name)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def fips_table(spark: SparkSession) -> DataFrame:
    """The 51-row state -> FIPS lookup as a DataFrame."""
    return spark.createDataFrame(sorted(STATE_FIPS.items()), "state string, fips_code int")


def with_fips(df: DataFrame, lookup: DataFrame, state_col: str = "state") -> DataFrame:
    """Inner join to a (state, code) lookup; states without a code yield no rows. The lookup is any
    table, so the join strategy is left to the planner, which broadcasts it below its size limit."""
    key, code = lookup.columns[:2]
    lk = lookup.select(F.col(key).alias("_lookup_state"), F.col(code))
    return df.join(lk, df[state_col] == lk["_lookup_state"], "inner").drop("_lookup_state")


def filter_regular_schools(df: DataFrame, fips: int | None = None, year: int | None = None) -> DataFrame:
    """The API's source-side restriction: regular schools, optionally one FIPS code and one year."""
    cond = F.col("school_type") == REGULAR_SCHOOL_TYPE
    if fips is not None:
        cond = cond & (F.col("fips") == fips)
    if year is not None:
        cond = cond & (F.col("year") == year)
    return df.where(cond)


def derive_school_ratios(df: DataFrame) -> DataFrame:
    """student_teacher_ratio = enrollment (null as 0) / teachers (0 as null); free_lunch_pct =
    free_lunch (null as 0) / enrollment (0 as null) * 100; both rounded to 1 decimal, half to even."""
    enrollment = F.coalesce(F.col("enrollment").cast("double"), F.lit(0.0))
    ratio = enrollment / F.nullif(F.col("teachers_fte").cast("double"), F.lit(0.0))
    lunch = F.coalesce(F.col("free_lunch").cast("double"), F.lit(0.0)) / F.nullif(F.col("enrollment").cast("double"), F.lit(0.0)) * 100
    return df.withColumn("student_teacher_ratio", round_half_even(ratio, 1)).withColumn("free_lunch_pct", round_half_even(lunch, 1))


# ---------------------------------------------------------------- city/zip mapping (A-08, O-01, J-09)

def city_zip_sets(panel: DataFrame) -> DataFrame:
    """Per (city, state, state_name): sorted distinct postal codes and their count.
    The set is bounded by the number of distinct codes of one city and is de-duplicated map-side."""
    base = panel.where(F.col("city").isNotNull() & F.col("state").isNotNull())
    return base.groupBy("city", "state", "state_name").agg(
        F.sort_array(F.collect_set("zip_code")).alias("zip_codes"),
        F.countDistinct("zip_code").alias("zip_count"),
    )


def top_cities(city_sets: DataFrame, n: int = 100) -> DataFrame:
    """Cities with the most postal codes (ties broken by city, state)."""
    return city_sets.orderBy(F.col("zip_count").desc(), "city", "state").limit(n)


def zip_city_map(panel: DataFrame) -> DataFrame:
    return panel.where(F.col("city").isNotNull()).select("zip_code", "city", "state_name").distinct()


def map_to_zip(city_amenities: DataFrame, zip_map: DataFrame, part_rows: int | None = None) -> DataFrame:
    """Copy each city-level amenity to every postal code of its (city, state_name) - a
    many-to-many equi-join; the join strategy is left to AQE's runtime size check. With ``part_rows`` cities
    whose output is larger are dealt over tasks of about that size (``operators.hotjoin``)."""
    on = ["city", "state_name"]
    joined = city_amenities.join(zip_map, on, "inner") if part_rows is None else expanding_join(city_amenities, zip_map, on, part_rows)
    return joined.select("zip_code", "amenity_name", "amenity_type", "amenity_category", "latitude", "longitude",
                         "city", "state_name")


# ---------------------------------------------------------------- raw writes and profiles (S-09..S-16)

def ensure_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}")


def write_raw(df: DataFrame, path: str, partition_by: Sequence[str] = (), skip_empty: bool = False) -> bool:
    """Overwrite-write a raw table as parquet (optionally partitioned, e.g. by year for pruning).
    With ``skip_empty`` an empty input writes nothing (a one-row probe, not a count)."""
    if skip_empty and df.isEmpty():
        return False
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return True


def profile_panel(df: DataFrame, key: str = "zip_code", date: str = "date") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct(key).alias("zip_count"),
        F.min(date).alias("earliest_date"),
        F.max(date).alias("latest_date"),
    )


def profile_by_category(df: DataFrame, category: str = "amenity_category", key: str = "zip_code") -> DataFrame:
    return (df.groupBy(category)
            .agg(F.count(F.lit(1)).alias("count"), F.countDistinct(key).alias("zips_covered"))
            .orderBy(F.col("count").desc(), F.col(category)))


def profile_by_year(df: DataFrame) -> DataFrame:
    return (df.groupBy("year").agg(
        F.count(F.lit(1)).alias("school_count"),
        F.countDistinct("zip_code").alias("zip_count"),
        tie_safe_round(F.avg("enrollment"), 0).alias("avg_enrollment"),
        tie_safe_round(F.avg("student_teacher_ratio"), 1).alias("avg_student_teacher_ratio"),
    ).orderBy("year"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return count_by(df, col)
