"""Ingestion: wide panels, API pages, lookups, key cleaning, profiles, city/zip mapping (S-01..S-16, C-17, C-18, J-09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from areascope import oracle as O
from areascope.functions import labels as L
from areascope.functions.keys import school_zip, tag
from areascope.operators import aggregates as AG
from areascope.plans import staging as STG
from areascope.queries.base import layers, register
from areascope.sources import ingest as ING
from areascope.sources import landed as LD
from areascope.session import materialize
from areascope.sources.tables import read_table



@register("unpivot_panel", O.with_models("""
SELECT region_id, size_rank, zip_code, region_type, state_name, state, city, metro, county, date, home_value
FROM raw_home_values"""))
def q_unpivot_panel(spark, sf_dir):
    """The landed wide CSV (one column per month) melted to the long panel, ids typed."""
    long = ING.wide_to_long(ING.read_wide_csv(spark, layers(spark, sf_dir).landed_wide_csv), "home_value")
    return long.withColumns({"region_id": F.col("region_id").cast("int"), "size_rank": F.col("size_rank").cast("int")})


@register("wide_csv_panel", O.with_models("""
SELECT CAST(region_id AS VARCHAR) AS region_id, zip_code, metro, count(*) AS months, min(date) AS first_month, max(home_value) AS top_value
FROM raw_home_values GROUP BY ALL"""))
def q_wide_csv_panel(spark, sf_dir):
    """Each row of the wide CSV as read (ids are text): its months with a value, the first and the largest value."""
    long = ING.wide_to_long(ING.read_wide_csv(spark, layers(spark, sf_dir).landed_wide_csv), "home_value")
    return long.groupBy("region_id", "zip_code", "metro").agg(
        F.count(F.lit(1)).alias("months"), F.min("date").alias("first_month"), F.max("home_value").alias("top_value"))


@register("union_school_years", O.with_models("""
SELECT year, count(*) AS schools, CAST(sum(enrollment) AS BIGINT) AS pupils, count(DISTINCT zip_code) AS areas
FROM raw_schools WHERE school_level <> 5 GROUP BY year"""))
def q_union_school_years(spark, sf_dir):
    """Regular schools of the landed pages, year by year as they are fetched, in one table."""
    pages = ING.read_school_pages(spark, layers(spark, sf_dir).landed_schools, multi_line=False)
    recs = materialize(ING.flatten_school_json(pages), "school_years", ("year",), rebalance=False)      # the pages are parsed once; each year reads its folder
    first, last = recs.agg(F.min("year"), F.max("year")).first()
    frames = [ING.filter_regular_schools(recs, year=y) for y in range(first, last + 1)]
    return ING.union_years(*frames).groupBy("year").agg(
        F.count(F.lit(1)).alias("schools"), F.sum(F.col("enrollment").cast("int")).alias("pupils"), F.countDistinct("zip_code").alias("areas"))


@register("amenity_json_flatten", O.with_models("""
SELECT CASE WHEN l.l_linenumber % 3 <> 0 THEN p.p_name ELSE 'unnamed' END AS amenity_name,
       CASE p.p_type WHEN 'ECONOMY' THEN 'park' WHEN 'SMALL' THEN 'supermarket' WHEN 'MEDIUM' THEN 'cinema'
                     WHEN 'LARGE' THEN 'restaurant' WHEN 'PROMO' THEN 'marketplace' END AS amenity_type,
       CASE p.p_type WHEN 'ECONOMY' THEN 'parks' WHEN 'SMALL' THEN 'shopping' WHEN 'MEDIUM' THEN 'entertainment'
                     WHEN 'LARGE' THEN 'dining' WHEN 'PROMO' THEN 'shopping' END AS amenity_category,
       l.l_discount * 100 AS latitude, l.l_tax * 100 AS longitude, d.city, d.state_name
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN dim d ON l.l_suppkey = d.s_suppkey
WHERE p.p_type <> 'STANDARD'"""))
def q_amenity_json_flatten(spark, sf_dir):
    """Points-of-interest API pages landed as files -> read by executors -> one classified row per element."""
    landed = layers(spark, sf_dir).landed_amenities
    return ING.flatten_amenity_json(ING.read_amenity_responses(spark, landed, multi_line=False))


@register("school_json_flatten", O.with_models("""
SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS nces_school_id,
       d.zip_code, d.state, CAST(year(l.l_shipdate) + 21 AS INTEGER) AS year,
       CAST(l.l_linenumber AS INTEGER) AS school_level, CAST(trunc(l.l_quantity) AS INTEGER) AS enrollment,
       round_even(coalesce(l.l_quantity, 0) / nullif(l.l_tax * 100, 0), 1) AS student_teacher_ratio,
       round_even(floor(l.l_quantity * l.l_discount) / nullif(l.l_quantity, 0) * 100, 1) AS free_lunch_pct,
       CASE WHEN l.l_linenumber = 1 THEN 'Primary' WHEN l.l_linenumber = 2 THEN 'Middle' WHEN l.l_linenumber = 3 THEN 'High'
            WHEN l.l_linenumber = 4 THEN 'Other' ELSE 'Unknown' END AS school_level_name
FROM lineitem l JOIN dim d ON l.l_suppkey = d.s_suppkey
WHERE l.l_linenumber <> 5 AND l.l_quantity > 0"""))
def q_school_json_flatten(spark, sf_dir):
    """School-directory API pages -> records -> regular schools -> ratios -> staged."""
    landed = layers(spark, sf_dir).landed_schools
    recs = ING.flatten_school_json(ING.read_school_pages(spark, landed, multi_line=False))
    staged = STG.stage_schools(ING.derive_school_ratios(ING.filter_regular_schools(recs)))
    return staged.select("nces_school_id", "zip_code", "state", "year", "school_level", "enrollment",
                         "student_teacher_ratio", "free_lunch_pct", "school_level_name")


@register("fips_lookup", O.with_models("""
SELECT s.nces_school_id, s.zip_code, s.state, s.year, n.n_nationkey AS fips_code
FROM stg_schools s JOIN nation n ON s.state = n.n_name"""))
def q_fips_lookup(spark, sf_dir):
    """State -> code lookup as a broadcast inner join (states without a code drop)."""
    schools = layers(spark, sf_dir).stg_schools.select("nces_school_id", "zip_code", "state", "year")
    return ING.with_fips(schools, LD.nation_codes(spark, sf_dir))


@register("school_zip_keys", """
SELECT o_orderkey,
       CASE WHEN split_part(coalesce(m, loc), '-', 1) = '' THEN NULL
            WHEN length(split_part(coalesce(m, loc), '-', 1)) < 5 THEN lpad(split_part(coalesce(m, loc), '-', 1), 5, '0')
            ELSE split_part(coalesce(m, loc), '-', 1) END AS zip_code,
       cust_zip
FROM (SELECT o_orderkey,
             CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) || '-' || CAST(o_orderkey % 10000 AS VARCHAR) END AS m,
             CAST(o_orderkey AS VARCHAR) AS loc,
             CASE WHEN length(CAST(o_custkey AS VARCHAR)) < 5 THEN lpad(CAST(o_custkey AS VARCHAR), 5, '0')
                  ELSE CAST(o_custkey AS VARCHAR) END AS cust_zip
      FROM orders)""")
def q_school_zip_keys(spark, sf_dir):
    """Key cleaning: mailing code else location code, cut at '-', padded to 5 without truncation."""
    k = LD.order_keys(spark, sf_dir)
    return k.select("o_orderkey", school_zip(F.col("mailing"), F.col("location")).alias("zip_code"), "cust_zip")


@register("profile_home_values", O.with_models("""
SELECT count(*) AS row_count, count(DISTINCT zip_code) AS zip_count, min(date) AS earliest_date, max(date) AS latest_date
FROM stg_home_values"""))
def q_profile_home_values(spark, sf_dir):
    return ING.profile_panel(layers(spark, sf_dir).stg_home_values)


@register("profile_rental_prices", O.with_models("""
SELECT count(*) AS row_count, count(DISTINCT zip_code) AS zip_count, min(date) AS earliest_date, max(date) AS latest_date
FROM stg_rental_prices"""))
def q_profile_rental_prices(spark, sf_dir):
    return ING.profile_panel(layers(spark, sf_dir).stg_rental_prices)


@register("profile_category", O.with_models("""
SELECT amenity_category, count(*) AS count, count(DISTINCT zip_code) AS zips_covered
FROM stg_amenities GROUP BY amenity_category"""))
def q_profile_category(spark, sf_dir):
    return ING.profile_by_category(layers(spark, sf_dir).stg_amenities)


@register("profile_year", O.with_models("""
SELECT year, count(*) AS school_count, count(DISTINCT zip_code) AS zip_count,
       round(avg(enrollment) + 1e-9, 0) + 0.0 AS avg_enrollment,
       round(avg(student_teacher_ratio) + 1e-9, 1) + 0.0 AS avg_student_teacher_ratio
FROM stg_schools GROUP BY year"""))
def q_profile_year(spark, sf_dir):
    return ING.profile_by_year(layers(spark, sf_dir).stg_schools)


@register("school_level_counts", O.with_models("""
SELECT school_level_name, count(*) AS count FROM stg_schools GROUP BY school_level_name"""))
def q_school_level_counts(spark, sf_dir):
    return ING.value_counts(layers(spark, sf_dir).stg_schools, "school_level_name")


@register("city_zip_sets", O.with_models("""
SELECT city, state, state_name, array_to_string(list_sort(list(DISTINCT zip_code)), ',') AS zip_codes,
       count(DISTINCT zip_code) AS zip_count
FROM raw_home_values WHERE city IS NOT NULL AND state IS NOT NULL GROUP BY city, state, state_name"""))
def q_city_zip_sets(spark, sf_dir):
    sets = ING.city_zip_sets(layers(spark, sf_dir).raw_home_values)
    return sets.select("city", "state", "state_name", F.array_join("zip_codes", ",").alias("zip_codes"), "zip_count")


@register("top_cities", O.with_models("""
SELECT city, state, state_name, count(DISTINCT zip_code) AS zip_count
FROM raw_home_values WHERE city IS NOT NULL AND state IS NOT NULL GROUP BY city, state, state_name
ORDER BY zip_count DESC, city, state LIMIT 100"""))
def q_top_cities(spark, sf_dir):
    sets = ING.city_zip_sets(layers(spark, sf_dir).raw_home_values)
    return ING.top_cities(sets, 100).select("city", "state", "state_name", "zip_count")


@register("map_to_zip", O.with_models("""
SELECT a.zip_code, x.amenity_name, x.amenity_type, x.amenity_category, x.latitude, x.longitude, x.city, x.state_name
FROM raw_amenities x
JOIN (SELECT DISTINCT zip_code, city, state_name FROM raw_home_values WHERE city IS NOT NULL) a
  ON x.city = a.city AND x.state_name = a.state_name"""))
def q_map_to_zip(spark, sf_dir):
    """City-level amenities copied to every postal code of their city (many-to-many equi-join)."""
    raw = layers(spark, sf_dir).raw_amenities
    city_level = raw.drop("zip_code")
    return ING.map_to_zip(city_level, ING.zip_city_map(layers(spark, sf_dir).raw_home_values))


@register("amenity_zip_coverage", O.with_models("SELECT count(DISTINCT zip_code) AS n FROM raw_amenities"))
def q_amenity_zip_coverage(spark, sf_dir):
    return AG.nunique(layers(spark, sf_dir).raw_amenities, "zip_code")


@register("json_props_category", """
SELECT event_id, event_type,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       coalesce(json_extract_string(props, '$.name'), 'unnamed') AS name,
       CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 80 THEN 'excellent'
            WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 60 THEN 'good'
            WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 40 THEN 'average'
            WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 20 THEN 'below_average'
            ELSE 'poor' END AS category
FROM events""")
def q_json_props_category(spark, sf_dir):
    """JSON property strings -> map -> keyed lookups with a default -> tier label (events table)."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    props = F.from_json("props", "map<string,string>")
    k = tag(props, "k").cast("int")
    return ev.select("event_id", "event_type", k.alias("k"), tag(props, "name", "unnamed").alias("name"),
                     L.tier(k).alias("category"))
