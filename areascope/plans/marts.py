"""Marts: market intelligence (livability), investment hotspots, metro comparison (C-07..C-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areascope.functions import labels as L
from areascope.functions.numeric import as_score, default, safe_div, scale_clip, share_pct, tie_safe_round, weighted_sum
from areascope.operators.aggregates import approx_median, count_when, rounded_avg
from areascope.operators.ranking import rank_within

# Composite weights and the two defaults the reference uses for a missing score.
LIVABILITY_WEIGHTS = {"price": "0.25", "yield": "0.20", "neighborhood": "0.30", "school": "0.25"}
INVESTMENT_WEIGHTS = {"yield": "0.35", "appreciation": "0.35", "neighborhood": "0.15", "school": "0.15"}
DISPLAY_DEFAULT = 0
LIVABILITY_DEFAULT = 50
APPRECIATION_RANGE = (-10, 10)
YIELD_RANGE = (0, 10)
DOWN_PAYMENT = 0.25


def _livability_sum(apprec, gross_yield, nbhd, school):
    return weighted_sum([
        (scale_clip(apprec, *APPRECIATION_RANGE), LIVABILITY_WEIGHTS["price"]),
        (scale_clip(default(gross_yield, 0), *YIELD_RANGE), LIVABILITY_WEIGHTS["yield"]),
        (as_score(default(nbhd, LIVABILITY_DEFAULT)), LIVABILITY_WEIGHTS["neighborhood"]),
        (as_score(default(school, LIVABILITY_DEFAULT)), LIVABILITY_WEIGHTS["school"]),
    ])


def assemble(trends: DataFrame, yields: DataFrame, neighborhood: DataFrame, schools: DataFrame) -> DataFrame:
    """Price trends (required) left-joined with yields and the neighborhood and school scores, whose columns get the
    prefixes ``_ns_`` and ``_sc_``.

    All four are per-area tables. Stored in buckets of ``zip_code`` they are joined without a shuffle whatever their size;
    otherwise AQE picks broadcast or sort-merge for each join from their measured size."""
    ry = yields.select(
        "zip_code",
        F.col("current_rent").alias("monthly_rent"), "annual_rent",
        F.col("current_yield").alias("gross_rental_yield"),
        F.col("yield_change_1yr_bps").alias("yield_change_1yr"),
        "rent_growth_1yr_pct", "yield_tier", "yield_trend",
    )
    ns = neighborhood.select(
        "zip_code",
        *[F.col(c).alias(f"_ns_{c}") for c in (
            "parks_count", "shopping_count", "entertainment_count", "dining_count", "parks_score",
            "shopping_score", "entertainment_score", "dining_score", "neighborhood_score", "neighborhood_tier")],
    )
    sc = schools.select(
        "zip_code",
        *[F.col(c).alias(f"_sc_{c}") for c in (
            "school_count", "total_enrollment", "avg_student_teacher_ratio", "primary_schools", "middle_schools",
            "high_schools", "enrollment_change_5yr_pct", "school_score", "school_tier", "school_trend")],
    )
    return trends.join(ry, "zip_code", "left").join(ns, "zip_code", "left").join(sc, "zip_code", "left")


def market_intelligence(trends: DataFrame, yields: DataFrame, neighborhood: DataFrame, schools: DataFrame) -> DataFrame:
    """One scored row per area: the four assembled sources, livability composite, tier and rank within metro."""
    m = assemble(trends, yields, neighborhood, schools)
    livability = F.round(_livability_sum(F.col("annual_appreciation_rate"), F.col("gross_rental_yield"),
                                         F.col("_ns_neighborhood_score"), F.col("_sc_school_score")), 1).cast("double")
    out = m.select(
        "zip_code", "city", "state", "state_name", "metro", "county", "as_of_date",
        F.col("current_value").alias("home_value"),
        F.col("pct_change_30d").alias("price_change_30d_pct"),
        F.col("pct_change_6m").alias("price_change_6m_pct"),
        F.col("pct_change_1yr").alias("price_change_1yr_pct"),
        F.col("dollar_change_1yr").alias("price_change_1yr_dollars"),
        "annual_appreciation_rate", "price_trend", "price_momentum",
        "monthly_rent", "annual_rent", "gross_rental_yield", "yield_change_1yr", "rent_growth_1yr_pct",
        "yield_tier", "yield_trend",
        *[default(F.col(f"_ns_{c}"), 0).alias(c) for c in (
            "parks_count", "shopping_count", "entertainment_count", "dining_count", "parks_score",
            "shopping_score", "entertainment_score", "dining_score", "neighborhood_score")],
        default(F.col("_ns_neighborhood_tier"), "no_data").alias("neighborhood_tier"),
        default(F.col("_sc_school_count"), 0).alias("school_count"),
        default(F.col("_sc_total_enrollment"), 0).alias("total_enrollment"),
        F.col("_sc_avg_student_teacher_ratio").alias("avg_student_teacher_ratio"),
        *[default(F.col(f"_sc_{c}"), 0).alias(c) for c in ("primary_schools", "middle_schools", "high_schools")],
        F.col("_sc_enrollment_change_5yr_pct").alias("enrollment_change_5yr_pct"),
        default(F.col("_sc_school_score"), 0).alias("school_score"),
        default(F.col("_sc_school_tier"), "no_data").alias("school_tier"),
        default(F.col("_sc_school_trend"), "no_data").alias("school_trend"),
        livability.alias("livability_score"),
    ).withColumn("livability_tier", L.tier(F.col("livability_score"), L.LIVABILITY_TIERS))
    return rank_within(out, "metro", "livability_score", out="metro_rank", descending=True)


def investment_hotspots(market: DataFrame) -> DataFrame:
    """Areas with rent: investment score, cash-on-cash estimate, signal and rank within metro
    (ranked on the unrounded score)."""
    base = market.where(F.col("monthly_rent").isNotNull() & F.col("gross_rental_yield").isNotNull())
    raw = weighted_sum([
        (scale_clip(F.col("gross_rental_yield"), *YIELD_RANGE), INVESTMENT_WEIGHTS["yield"]),
        (scale_clip(F.col("annual_appreciation_rate"), *APPRECIATION_RANGE), INVESTMENT_WEIGHTS["appreciation"]),
        (as_score(F.col("neighborhood_score")), INVESTMENT_WEIGHTS["neighborhood"]),
        (as_score(F.col("school_score")), INVESTMENT_WEIGHTS["school"]),
    ])
    out = base.select(
        "zip_code", "city", "state", "metro", "as_of_date",
        "home_value", "price_change_1yr_pct", "annual_appreciation_rate", "price_trend",
        "monthly_rent", "gross_rental_yield", "yield_tier", "rent_growth_1yr_pct",
        "neighborhood_score", "school_score",
        F.round(raw, 1).cast("double").alias("investment_score"),
        tie_safe_round(safe_div(F.col("monthly_rent") * 12, F.col("home_value") * DOWN_PAYMENT) * 100, 2).alias("cash_on_cash_estimate"),
        L.investment_signal(F.col("gross_rental_yield"), F.col("annual_appreciation_rate"), F.col("neighborhood_score")).alias("investment_signal"),
        raw.alias("_inv_order"),
    )
    return rank_within(out, "metro", "_inv_order", out="metro_investment_rank", descending=True).drop("_inv_order")


def area_comparison(market: DataFrame) -> DataFrame:
    """One row per metro: 26 aggregates in one grouped aggregation, which shrinks map-side, and the
    distinct areas counted apart (inside it, every partial would be one of a metro and an area, with
    a sketch each)."""
    m = market.where(F.col("metro").isNotNull())
    trend = F.col("price_trend")
    areas = m.select("metro", "zip_code").distinct().groupBy("metro").agg(F.count("zip_code").alias("zip_count"))
    return m.groupBy("metro").agg(
        F.max("state").alias("state"),
        F.max("as_of_date").alias("as_of_date"),
        rounded_avg("home_value", 0).alias("avg_home_value"),
        tie_safe_round(F.min("home_value"), 0).alias("min_home_value"),
        tie_safe_round(F.max("home_value"), 0).alias("max_home_value"),
        tie_safe_round(approx_median("home_value"), 0).alias("median_home_value"),
        rounded_avg("price_change_1yr_pct", 2).alias("avg_price_change_1yr_pct"),
        rounded_avg("annual_appreciation_rate", 2).alias("avg_appreciation_rate"),
        rounded_avg("monthly_rent", 0).alias("avg_monthly_rent"),
        rounded_avg("gross_rental_yield", 2).alias("avg_rental_yield"),
        rounded_avg("rent_growth_1yr_pct", 2).alias("avg_rent_growth_1yr_pct"),
        tie_safe_round(safe_div(F.avg("home_value"), F.avg(F.col("monthly_rent") * 12)), 1).alias("price_to_rent_ratio"),
        rounded_avg("neighborhood_score", 1).alias("avg_neighborhood_score"),
        rounded_avg("parks_score", 1).alias("avg_parks_score"),
        rounded_avg("shopping_score", 1).alias("avg_shopping_score"),
        rounded_avg("entertainment_score", 1).alias("avg_entertainment_score"),
        rounded_avg("dining_score", 1).alias("avg_dining_score"),
        rounded_avg("school_score", 1).alias("avg_school_score"),
        F.sum("school_count").alias("total_schools"),
        rounded_avg("avg_student_teacher_ratio", 1).alias("avg_student_teacher_ratio"),
        rounded_avg("livability_score", 1).alias("avg_livability_score"),
        count_when(F.col("livability_tier") == L.LIVABILITY_TIERS[0]).alias("premium_zips"),
        count_when(F.col("livability_tier") == L.LIVABILITY_TIERS[1]).alias("good_zips"),
        count_when(F.col("livability_tier") == L.LIVABILITY_TIERS[2]).alias("average_zips"),
        share_pct(count_when(trend.isin(L.PRICE_TRENDS[0], L.PRICE_TRENDS[1])), F.count(F.lit(1))).alias("pct_appreciating"),
        share_pct(count_when(trend.isin(L.PRICE_TRENDS[4], L.PRICE_TRENDS[3])), F.count(F.lit(1))).alias("pct_declining"),
    ).join(areas, "metro")


def source_coverage(trends: DataFrame, yields: DataFrame, neighborhood: DataFrame, schools: DataFrame) -> DataFrame:
    """For each area of the market mart, which of the optional sources it has; the mart's defaults stand in for the others."""
    m = assemble(trends, yields, neighborhood, schools)
    has = {"has_yield": "yield_tier", "has_neighborhood": "_ns_neighborhood_tier", "has_school": "_sc_school_tier"}
    flags = m.select("zip_code", "metro", *[F.col(c).isNotNull().alias(k) for k, c in has.items()])
    n = sum((F.col(k).cast("int") for k in has), F.lit(1))
    return flags.withColumn("n_sources", n)
