"""Landed files as they come: releases with other months, rewritten months, broken and missing pages, raw profiles
(S-01..S-09, S-12..S-15, U-02, U-03)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from areascope import oracle as O
from areascope.queries.base import layers, register
from areascope.session import ensure_checkpoint_dir
from areascope.sources import ingest as ING
from areascope.sources import landed as LD
from areascope.sources import pages as PG
from areascope.sources import releases as RL
from areascope.sources.tables import read_table
from areascope.streaming import amenity_page_stream, append_to_table

_PANEL = "region_id, size_rank, zip_code, region_type, state_name, state, city, metro, county, date, home_value"


def _typed(long):
    return long.withColumns({"region_id": F.col("region_id").cast("int"), "size_rank": F.col("size_rank").cast("int")})


@register("wide_csv_releases", O.with_models(f"""
SELECT coalesce(b.region_id, a.region_id) AS region_id, coalesce(b.zip_code, a.zip_code) AS zip_code, coalesce(b.metro, a.metro) AS metro,
       coalesce(b.date, a.date) AS date, coalesce(b.home_value, a.home_value) AS home_value
FROM (SELECT {_PANEL} FROM raw_home_values WHERE date <= (SELECT max(date) - INTERVAL 6 MONTH FROM raw_home_values)) a
FULL JOIN (SELECT {_PANEL.replace("home_value", "home_value + 1 AS home_value")} FROM raw_home_values
           WHERE date >= (SELECT min(date) + INTERVAL 12 MONTH FROM raw_home_values) AND region_id % 3 <> 0) b
  ON a.region_id = b.region_id AND a.date = b.date"""))
def q_wide_csv_releases(spark, sf_dir):
    """Two releases with other months (and other areas), the newer one revised, read in one go; the newest value wins."""
    panel = layers(spark, sf_dir).raw_home_values
    first, last = panel.agg(F.min("date"), F.max("date")).first()
    old = panel.where(F.col("date") <= F.add_months(F.lit(last), -6))
    new = panel.where((F.col("date") >= F.add_months(F.lit(first), 12)) & (F.col("region_id") % 3 != 0)).withColumn("home_value", F.col("home_value") + 1)
    paths = [LD.land_wide_csv(old, "home_value", "release-1"), LD.land_wide_csv(new, "home_value", "release-2")]
    long = RL.newest_wins(RL.read_wide_releases(spark, paths, "home_value"))
    return _typed(long).select("region_id", "zip_code", "metro", "date", "home_value")


@register("rewrite_month", O.with_models("SELECT region_id, zip_code, city, metro, date, home_value FROM raw_home_values"))
def q_rewrite_month(spark, sf_dir):
    """A raw table with a preliminary last month, of which the final release rewrites that month alone, read back by name."""
    panel = layers(spark, sf_dir).raw_home_values
    last = F.lit(panel.agg(F.max("date")).first()[0])
    name = f"areascope_raw.home_values_{uuid.uuid4().hex}"
    early = panel.where((F.col("date") < last) | (F.col("region_id") % 2 == 0))
    RL.write_raw_table(early.withColumn("home_value", F.when(F.col("date") == last, 0.0).otherwise(F.col("home_value"))), name, ("date",))
    table = RL.write_raw_table(panel.where(F.col("date") == last), name, ("date",), rewrite=True)
    return table.select("region_id", "zip_code", "city", "metro", "date", "home_value")


_PAGES = """
SELECT d.city, d.state_name, l.l_orderkey, CASE l.l_orderkey % 10 WHEN 3 THEN 'corrupt' WHEN 7 THEN 'incomplete' ELSE 'good' END AS status,
       count(*) FILTER (WHERE p.p_type <> 'STANDARD') AS n
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN dim d ON l.l_suppkey = d.s_suppkey GROUP BY ALL"""


def _bad_day(spark, sf_dir):
    p = layers(spark, sf_dir)
    path = LD.land_documents(LD.broken_documents(LD.amenity_documents(spark, sf_dir, p.area_dimension)), "bad-day")
    return PG.sort_pages(spark, path, ING.AMENITY_RESPONSE_SCHEMA, ["city", "state_name", "elements"])


@register("quarantined_pages", O.with_models(f"""
SELECT status, count(*) AS pages, CAST(coalesce(sum(n) FILTER (status = 'good'), 0) AS BIGINT) AS amenities FROM ({_PAGES}) GROUP BY status"""))
def q_quarantined_pages(spark, sf_dir):
    """Pages of a bad day by status, with the amenities that the good ones gave: together all lines that landed."""
    pages = _bad_day(spark, sf_dir)
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = pages.good.select(F.lit(PG.GOOD).alias("status"), one.alias("page"), none.alias("amenity")) \
        .unionAll(ING.flatten_amenity_json(pages.good).select(F.lit(PG.GOOD), none, one)) \
        .unionAll(pages.quarantine.select("reason", one, none))
    return rows.groupBy("status").agg(F.sum("page").alias("pages"), F.sum("amenity").alias("amenities"))


@register("good_pages_by_city", O.with_models(f"""
SELECT city, state_name, CAST(sum(n) AS BIGINT) AS amenities, count(*) AS pages FROM ({_PAGES}) WHERE status = 'good' GROUP BY ALL"""))
def q_good_pages_by_city(spark, sf_dir):
    """Ingestion goes on after bad pages: pages and classified amenities of each city."""
    good = _bad_day(spark, sf_dir).good
    found = ING.flatten_amenity_json(good).groupBy("city", "state_name").agg(F.count(F.lit(1)).alias("amenities"))
    pages = good.groupBy("city", "state_name").agg(F.count(F.lit(1)).alias("pages"))
    return pages.join(found, ["city", "state_name"], "left").select("city", "state_name", F.coalesce("amenities", F.lit(0).cast("long")).alias("amenities"), "pages")


@register("school_page_chains", O.with_models(f"""
SELECT request, CAST(coalesce(min(k) FILTER (lost), max(k) + 1) - 1 AS BIGINT) AS pages_reached, count(*) FILTER (lost) = 0 AS complete,
       request || '/' || CAST(min(k) FILTER (lost) AS VARCHAR) AS missing
FROM (SELECT request, l_orderkey % 37 = 5 AS lost, row_number() OVER (PARTITION BY request ORDER BY l_orderkey) AS k
      FROM (SELECT DISTINCT d.state || '/' || CAST(year(l.l_shipdate) + 21 AS VARCHAR) || '/' || CAST(l.l_orderkey // {LD.CHAIN_ORDERS} AS VARCHAR) AS request,
                   l.l_orderkey FROM lineitem l JOIN dim d ON l.l_suppkey = d.s_suppkey)) GROUP BY request"""))
def q_school_page_chains(spark, sf_dir):
    """Each request for school pages: complete, or named with the page that is missing."""
    requests, pages = LD.school_chains(spark, sf_dir, layers(spark, sf_dir).area_dimension)
    return PG.follow_chains(requests, pages).select("request", "pages_reached", "complete", "missing")


_FIPS_ORDER = sorted(ING.STATE_FIPS)


@register("fips_codes", f"""
SELECT s_suppkey, state, fips_code FROM (SELECT s_suppkey, [{", ".join(repr(s) for s in [*_FIPS_ORDER, "PR", "XX"])}][CAST(s_suppkey % 53 AS INT) + 1] AS state FROM supplier)
JOIN (VALUES {", ".join(f"('{k}', {v})" for k, v in sorted(ING.STATE_FIPS.items()))}) f(abbr, fips_code) ON state = abbr""")
def q_fips_codes(spark, sf_dir):
    """State abbreviations looked up in the 51-row table; PR and XX have no code, so their rows go."""
    states = F.array(*[F.lit(s) for s in [*_FIPS_ORDER, "PR", "XX"]])
    areas = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(states, (F.col("s_suppkey") % 53).cast("int") + 1).alias("state"))
    return ING.with_fips(areas, ING.fips_table(spark))


@register("profile_raw_home_values", O.with_models("""
SELECT count(*) AS row_count, count(DISTINCT zip_code) AS zip_count, min(date) AS earliest_date, max(date) AS latest_date FROM raw_home_values"""))
def q_profile_raw_home_values(spark, sf_dir):
    """Profile of the raw panel, before any filter of staging."""
    return ING.profile_panel(layers(spark, sf_dir).raw_home_values)


@register("profile_raw_category", O.with_models("""
SELECT amenity_category, count(*) AS count, count(DISTINCT zip_code) AS zips_covered FROM raw_amenities GROUP BY amenity_category"""))
def q_profile_raw_category(spark, sf_dir):
    """Profile of the raw amenities; those without a category are a row of their own."""
    return ING.profile_by_category(layers(spark, sf_dir).raw_amenities)


@register("profile_raw_year", O.with_models("""
SELECT year, count(*) AS school_count, count(DISTINCT zip_code) AS zip_count, round(avg(enrollment) + 1e-9, 0) + 0.0 AS avg_enrollment,
       round(avg(student_teacher_ratio) + 1e-9, 1) + 0.0 AS avg_student_teacher_ratio
FROM raw_schools GROUP BY year"""))
def q_profile_raw_year(spark, sf_dir):
    """Profile of the raw schools by year."""
    return ING.profile_by_year(layers(spark, sf_dir).raw_schools)


@register("relanded_pages", O.with_models("""
SELECT d.city, d.state_name, count(*) AS amenities
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN dim d ON l.l_suppkey = d.s_suppkey WHERE p.p_type <> 'STANDARD' GROUP BY ALL"""))
def q_relanded_pages(spark, sf_dir):
    """All pages land, are streamed into a table, and land again under other names before the stream goes on: the table stays the same."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/areascope/stream-{uuid.uuid4().hex}"
    docs = LD.amenity_documents(spark, sf_dir, layers(spark, sf_dir).area_dimension)
    # pages of equal content are one page: an element without a class tells orders apart
    tagged = docs.withColumn("document", F.replace("document", F.lit('"elements":['), F.concat(
        F.lit('"elements":[{"lat":'), F.col("page").cast("string"), F.lit('.0,"tags":{"note":"page"}},'))))
    for again in (False, True):
        LD.write_pages(spark.read.text(f"{root}/landing").withColumnRenamed("value", "document") if again else tagged, f"{root}/landing")
        stream = amenity_page_stream(spark, f"{root}/landing", multi_line=False, once=True)
        append_to_table(stream, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/table").groupBy("city", "state_name").agg(F.count(F.lit(1)).alias("amenities"))
