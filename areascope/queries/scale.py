"""Operators for groups of any size: distinct counts that add up, exact medians, all levels in one aggregation, hot cities
(A-10, A-12, A-19, S-13, R-05, R-09, R-14, R-17, J-09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from areascope import oracle as O
from areascope.functions import labels as L
from areascope.operators.bitmaps import distinct_bitmaps, distinct_over
from areascope.operators.selection import exact_quantile
from areascope.plans import reports
from areascope.queries.base import layers, register
from areascope.session import materialize
from areascope.sources import ingest as ING


@register("areas_by_span", O.with_models("""
SELECT metro, 'quarter' AS span, CAST(date_trunc('quarter', date) AS DATE) AS first_day, count(DISTINCT region_id) AS areas
FROM stg_home_values GROUP BY ALL
UNION ALL SELECT metro, 'year', CAST(date_trunc('year', date) AS DATE), count(DISTINCT region_id) FROM stg_home_values GROUP BY ALL
UNION ALL SELECT NULL, 'all', min(date), count(DISTINCT region_id) FROM stg_home_values HAVING count(*) > 0"""))
def q_areas_by_span(spark, sf_dir):
    """Distinct areas with a value for each metro and quarter, metro and year, and in all, from one table of monthly bitmaps."""
    monthly = materialize(distinct_bitmaps(layers(spark, sf_dir).stg_home_values, ["metro", "date"], "region_id"), "area_bitmaps")
    parts = [distinct_over(monthly, ["metro", F.trunc("date", s).alias("first_day")], "areas").withColumn("span", F.lit(s)) for s in ("quarter", "year")]
    first = monthly.agg(F.min("date").alias("first_day")).withColumn("span", F.lit("all"))
    everything = distinct_over(monthly, [F.lit("all").alias("span")], "areas").join(first, "span").withColumn("metro", F.lit(None).cast("string"))
    return parts[0].unionByName(parts[1]).unionByName(everything)


@register("exact_median_by_metro", O.with_models("""
SELECT metro, quantile_disc(home_value, 0.5) AS median_value, quantile_disc(home_value, 0.9) AS top_tenth FROM stg_home_values GROUP BY metro"""))
def q_exact_median_by_metro(spark, sf_dir):
    """Exact median and ninth decile of all monthly values of each metro."""
    panel = layers(spark, sf_dir).stg_home_values
    half = exact_quantile(panel, ["metro"], "home_value", 0.5, "median_value")
    top = exact_quantile(panel, ["metro"], "home_value", 0.9, "top_tenth").withColumnRenamed("metro", "_metro")
    return half.join(top, half["metro"].eqNullSafe(top["_metro"])).drop("_metro")


_TIERS = ", ".join(f"count(*) FILTER (livability_tier = '{t}') AS tier_{t[0].lower()}" for t in L.LIVABILITY_TIERS)
_TRENDS = ", ".join(f"count(*) FILTER (price_trend = '{t}') AS {t}" for t in L.PRICE_TRENDS)


@register("kpis_by_level", O.with_models(f"""
SELECT CASE grouping(state, metro) WHEN 3 THEN 'all' WHEN 1 THEN 'state' ELSE 'metro' END AS level, state, metro, count(*) AS areas,
       count(gross_rental_yield) AS areas_with_yield, {O.near("avg(livability_score)", 1)} AS avg_livability, {O.near("avg(home_value)", 0)} AS avg_home_value,
       max(livability_score) AS top_livability, {_TIERS}, {_TRENDS}
FROM market_intelligence GROUP BY GROUPING SETS ((), (state), (state, metro)) HAVING count(*) > 0"""))
def q_kpis_by_level(spark, sf_dir):
    """KPIs, tiers and trends for all areas, each state and each metro of a state, in one aggregation."""
    return reports.levels(layers(spark, sf_dir).market_intelligence)


@register("map_to_zip_hot_city", O.with_models("""
SELECT m.zip_code, x.amenity_category, count(*) AS n
FROM (SELECT amenity_category, CASE WHEN length(amenity_name) % 3 = 0 THEN (SELECT min(city) FROM dim) ELSE city END AS city,
             CASE WHEN length(amenity_name) % 3 = 0 THEN (SELECT min_by(state_name, city) FROM dim) ELSE state_name END AS state_name FROM raw_amenities) x
JOIN (SELECT DISTINCT zip_code, city, state_name FROM raw_home_values WHERE city IS NOT NULL) m ON x.city = m.city AND x.state_name = m.state_name
GROUP BY ALL"""))
def q_map_to_zip_hot_city(spark, sf_dir):
    """Amenities copied to the postal codes of their city, where one city holds a third of them: it is dealt over many tasks."""
    p = layers(spark, sf_dir)
    place = p.area_dimension.agg(F.min(F.struct("city", "state_name")).alias("p")).first()["p"]
    hot = F.length("amenity_name") % 3 == 0
    city_level = p.raw_amenities.drop("zip_code").withColumns({
        "city": F.when(hot, F.lit(place["city"])).otherwise(F.col("city")),
        "state_name": F.when(hot, F.lit(place["state_name"])).otherwise(F.col("state_name"))})
    mapped = ING.map_to_zip(city_level, ING.zip_city_map(p.raw_home_values), part_rows=10_000)
    return mapped.groupBy("zip_code", "amenity_category").agg(F.count(F.lit(1)).alias("n"))
