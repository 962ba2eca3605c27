"""Staging views, intermediate models and marts (P-01..P-07, C-01..C-16)."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from areascope import oracle as O
from areascope.plans import intermediate, marts
from areascope.plans.build import build
from areascope.queries.base import layers, register, select_all


@register("stage_home_values", select_all("stg_home_values"))
def q_stage_home_values(spark, sf_dir):
    return layers(spark, sf_dir).stg_home_values


@register("stage_rental_prices", select_all("stg_rental_prices"))
def q_stage_rental_prices(spark, sf_dir):
    return layers(spark, sf_dir).stg_rental_prices


@register("stage_amenities", select_all("stg_amenities"))
def q_stage_amenities(spark, sf_dir):
    return layers(spark, sf_dir).stg_amenities


@register("stage_schools", select_all("stg_schools"))
def q_stage_schools(spark, sf_dir):
    return layers(spark, sf_dir).stg_schools


# ------------------------------------------------------------------ intermediate and marts
@register("price_trends", select_all("int_price_trends"))
def q_price_trends(spark, sf_dir):
    return layers(spark, sf_dir).price_trends


@register("rental_yield", select_all("int_rental_yield"))
def q_rental_yield(spark, sf_dir):
    return layers(spark, sf_dir).rental_yield


@register("neighborhood_score", select_all("int_neighborhood_score"))
def q_neighborhood_score(spark, sf_dir):
    return layers(spark, sf_dir).neighborhood_score


@register("school_score", select_all("int_school_score"))
def q_school_score(spark, sf_dir):
    return layers(spark, sf_dir).school_score


@register("livability", select_all("market_intelligence"))
def q_livability(spark, sf_dir):
    return layers(spark, sf_dir).market_intelligence


@register("source_coverage", O.with_models("""
SELECT t.zip_code, t.metro, y.zip_code IS NOT NULL AS has_yield, n.zip_code IS NOT NULL AS has_neighborhood, s.zip_code IS NOT NULL AS has_school,
       1 + CAST(y.zip_code IS NOT NULL AS INTEGER) + CAST(n.zip_code IS NOT NULL AS INTEGER) + CAST(s.zip_code IS NOT NULL AS INTEGER) AS n_sources
FROM int_price_trends t LEFT JOIN int_rental_yield y USING (zip_code) LEFT JOIN int_neighborhood_score n USING (zip_code)
     LEFT JOIN int_school_score s USING (zip_code)"""))
def q_source_coverage(spark, sf_dir):
    """Which sources each area of the market mart has, from the bucketed layers."""
    p = layers(spark, sf_dir)
    return marts.source_coverage(p.price_trends, p.rental_yield, p.neighborhood_score, p.school_score)


@register("investment", select_all("investment_hotspots"))
def q_investment(spark, sf_dir):
    return layers(spark, sf_dir).investment_hotspots


@register("area_comparison", select_all("area_comparison"))
def q_area_comparison(spark, sf_dir):
    return layers(spark, sf_dir).area_comparison


@register("build_marts", O.with_models("""
SELECT 'market_intelligence' AS mart, count(*) AS n, round(sum(livability_score), 1) AS total FROM market_intelligence
UNION ALL SELECT 'investment_hotspots', count(*), round(sum(investment_score), 1) FROM investment_hotspots
UNION ALL SELECT 'area_comparison', count(*), round(sum(avg_livability_score), 1) FROM area_comparison"""))
def q_build_marts(spark, sf_dir):
    """All layers built as catalog tables of a schema, the marts read back by name."""
    built = build(layers(spark, sf_dir), "areascope_build")
    scores = {"market_intelligence": "livability_score", "investment_hotspots": "investment_score", "area_comparison": "avg_livability_score"}
    parts = [built[m].agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(c), 1).alias("total")).select(F.lit(m).alias("mart"), "n", "total")
             for m, c in scores.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("school_score_zip", O.with_models("""
SELECT zip_code, city || ' 1' AS city, state, school_count, total_enrollment, school_score, school_tier, school_trend FROM (
  SELECT * EXCLUDE (city), max(city) OVER (PARTITION BY zip_code) AS city FROM int_school_score)"""))
def q_school_score_zip(spark, sf_dir):
    """School scores at zip grain, where a zip has two spellings of its city."""
    schools = layers(spark, sf_dir).stg_schools
    current = Window.partitionBy("zip_code", "year")
    spelled = F.when(F.col("nces_school_id") == F.max("nces_school_id").over(current), "1").otherwise("0")
    schools = schools.withColumn("city", F.concat_ws(" ", "city", spelled))
    scored = intermediate.school_score(schools, grain="zip")
    return scored.select("zip_code", "city", "state", "school_count", "total_enrollment", "school_score", "school_tier", "school_trend")


@register("price_trends_month_end", O.with_models(f"""
SELECT zip_code, as_of_date, now AS current_value, v1yr AS value_1yr_ago, {O.cents("now", "v1yr")} + 0.0 AS dollar_change_1yr,
       CASE WHEN v1yr IS NULL THEN 'no_history' ELSE {O.ladder(O.growth("now", "v1yr"), [
           ("> 0.05::DOUBLE", "strong_appreciation"), ("> 0.01::DOUBLE", "moderate_appreciation"),
           ("> -0.01::DOUBLE", "stable"), ("> -0.05::DOUBLE", "moderate_decline")], "strong_decline")} END AS price_trend
FROM (SELECT zip_code, any_value(latest) AS as_of_date, {O.at("home_value", 0)} AS now, {O.at("home_value", 12)} AS v1yr
      FROM ({O.back_by_month("(SELECT * REPLACE (last_day(date) AS date) FROM stg_home_values)",
                             "(SELECT max(last_day(date)) FROM stg_home_values)")}) GROUP BY zip_code HAVING now IS NOT NULL)"""))
def q_price_trends_month_end(spark, sf_dir):
    """Month-end panel: lookbacks by month, and a label of its own for areas without history."""
    panel = layers(spark, sf_dir).stg_home_values.withColumn("date", F.last_day("date"))
    trends = intermediate.price_trends(panel, align="month", null_label="no_history")
    return trends.select("zip_code", "as_of_date", "current_value", "value_1yr_ago", "dollar_change_1yr", "price_trend")
