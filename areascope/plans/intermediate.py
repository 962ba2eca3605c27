"""Intermediate models: price trends, rental yield, neighborhood score, school score (C-01..C-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areascope.functions import labels as L
from areascope.functions.numeric import (
    as_score,
    change_ratio,
    money_change,
    pct_change,
    safe_div,
    tie_safe_round,
    weighted_score,
)
from areascope.operators.aggregates import category_counts, count_when, rounded_avg
from areascope.operators.panel import common_latest_value, latest_date_value, lookback, multi_series_lookback
from areascope.operators.ranking import percent_rank_scores

# Lookback output names and offsets in months.
PRICE_LOOKBACKS = {"value_30d_ago": 1, "value_6m_ago": 6, "value_1yr_ago": 12}
YIELD_LOOKBACKS = {"30d": 1, "6m": 6, "1yr": 12}
# Composite weights.
NEIGHBORHOOD_WEIGHTS = (("parks_score", "0.30"), ("shopping_score", "0.20"), ("entertainment_score", "0.25"), ("dining_score", "0.25"))
SCHOOL_WEIGHTS = (("str_score", "0.40"), ("choice_score", "0.30"), ("level_diversity_score", "0.30"))
CURRENT_SCHOOL_YEAR, BASE_SCHOOL_YEAR = 2022, 2017


def price_trends(home_values: DataFrame, align: str = "exact", null_label: str | None = None) -> DataFrame:
    """One row per area at the latest date: value now, 1/6/12 months back, % and $ changes,
    trend and momentum. One shuffle (conditional aggregate), no self-joins. ``align="month"`` takes
    any day of a month; ``null_label`` names the trend of an area without history."""
    ref = latest_date_value(home_values)
    lb = lookback(home_values, "zip_code", "home_value", ref, PRICE_LOOKBACKS,
                  current="current_value", carry=("city", "state", "state_name", "metro", "county"), align=align)
    cur = F.col("current_value")
    v30, v6, v1y = F.col("value_30d_ago"), F.col("value_6m_ago"), F.col("value_1yr_ago")
    return lb.select(
        "zip_code", "city", "state", "state_name", "metro", "county",
        ref.alias("as_of_date"),
        "current_value", "value_30d_ago", "value_6m_ago", "value_1yr_ago",
        pct_change(cur, v30).alias("pct_change_30d"),
        pct_change(cur, v6).alias("pct_change_6m"),
        pct_change(cur, v1y).alias("pct_change_1yr"),
        money_change(cur, v30).alias("dollar_change_30d"),
        money_change(cur, v6).alias("dollar_change_6m"),
        money_change(cur, v1y).alias("dollar_change_1yr"),
        pct_change(cur, v1y).alias("annual_appreciation_rate"),
        L.price_trend(change_ratio(cur, v1y), null_label).alias("price_trend"),
        L.price_momentum(tie_safe_round(change_ratio(cur, v30) * 100 * 12, 2), pct_change(cur, v1y)).alias("price_momentum"),
    )


def _gross_yield(rent, value):
    return tie_safe_round(safe_div(rent * 12, value) * 100, 2)


def rental_yield(rents: DataFrame, home_values: DataFrame, align: str = "exact") -> DataFrame:
    """Gross yield at the latest date both panels share, yields 1/6/12 months back, bps changes,
    rent growth, tier and trend. Both panels go through ONE grouped shuffle."""
    ref = common_latest_value([rents, home_values])
    g = multi_series_lookback(
        {"rent": (rents, "rental_price"), "value": (home_values, "home_value")},
        "zip_code", ref, YIELD_LOOKBACKS, carry_from="rent", carry=("city", "state", "metro"), align=align,
    )
    g = g.where(F.col("rent").isNotNull() & F.col("value").isNotNull() & (F.col("rent") > 0) & (F.col("value") > 0))
    rent, value = F.col("rent"), F.col("value")
    cy = _gross_yield(rent, value)
    ys = {k: _gross_yield(F.col(f"rent_{k}"), F.col(f"value_{k}")) for k in YIELD_LOOKBACKS}
    out = g.select(
        "zip_code", "city", "state", "metro", ref.alias("as_of_date"),
        rent.alias("current_rent"), value.alias("current_value"), cy.alias("current_yield"),
        tie_safe_round(rent * 12, 0).alias("annual_rent"),
        *[ys[k].alias(f"yield_{k}_ago") for k in YIELD_LOOKBACKS],
        pct_change(rent, F.col("rent_1yr")).alias("rent_growth_1yr_pct"),
    )
    cy = F.col("current_yield")
    return out.select(
        "zip_code", "city", "state", "metro", "as_of_date", "current_rent", "current_value", "current_yield",
        "annual_rent", "yield_30d_ago", "yield_6m_ago", "yield_1yr_ago",
        *[tie_safe_round((cy - F.col(f"yield_{k}_ago")) * 100, 0).alias(f"yield_change_{k}_bps") for k in YIELD_LOOKBACKS],
        "rent_growth_1yr_pct",
        L.yield_tier(cy).alias("yield_tier"),
        L.yield_trend(cy, F.col("yield_1yr_ago")).alias("yield_trend"),
    )


def neighborhood_score(amenities: DataFrame, grain: str = "reference") -> DataFrame:
    """Category counts per area -> global percentile scores -> weighted score -> tier.

    ``grain="reference"`` groups by (zip_code, city, state_name) like the reference (an area with
    two city spellings yields two rows); ``grain="zip"`` groups by zip_code with ``max`` of the
    names, which keeps zip_code unique.
    """
    cats = {f"{c}_count": c for c in L.AMENITY_CATEGORIES}
    aggs = [*category_counts("amenity_category", cats), F.count(F.lit(1)).alias("total_amenities")]
    if grain == "reference":
        counts = amenities.groupBy("zip_code", "city", "state_name").agg(*aggs)
    elif grain == "zip":
        counts = amenities.groupBy("zip_code").agg(F.max("city").alias("city"), F.max("state_name").alias("state_name"), *aggs)
    else:
        raise ValueError(grain)
    scored = percent_rank_scores(counts, {f"{c}_score": (f"{c}_count", True) for c in L.AMENITY_CATEGORIES})
    score = weighted_score([(as_score(F.col(c)), w) for c, w in NEIGHBORHOOD_WEIGHTS])
    return scored.select(
        "zip_code", "city", "state_name",
        *cats.keys(), "total_amenities",
        *[f"{c}_score" for c in L.AMENITY_CATEGORIES],
        score.alias("neighborhood_score"),
    ).withColumn("neighborhood_tier", L.tier(F.col("neighborhood_score")))


def school_score(schools: DataFrame, current_year: int = CURRENT_SCHOOL_YEAR, base_year: int = BASE_SCHOOL_YEAR,
                 grain: str = "reference") -> DataFrame:
    """Current-year aggregates per area, 5-year change against the base year, percentile
    components, level diversity, weighted score, tier and trend. ``grain="reference"`` groups by
    (zip_code, city, state); ``grain="zip"`` by zip_code with ``max`` of the names, so zip_code is unique."""
    yr = F.col("year")
    if grain not in ("reference", "zip"):
        raise ValueError(grain)
    keys = ["zip_code", "city", "state"] if grain == "reference" else ["zip_code"]
    names = [] if grain == "reference" else [F.max("city").alias("city"), F.max("state").alias("state")]
    cur = schools.where(yr == current_year).groupBy(*keys).agg(
        *names,
        F.count(F.lit(1)).alias("school_count"),
        F.sum("enrollment").alias("total_enrollment"),
        rounded_avg("student_teacher_ratio", 1).alias("avg_student_teacher_ratio"),
        rounded_avg("free_lunch_pct", 1).alias("avg_free_lunch_pct"),
        count_when(F.col("charter") == 1).alias("charter_count"),
        count_when(F.col("magnet") == 1).alias("magnet_count"),
        count_when(F.col("school_level") == 1).alias("primary_schools"),
        count_when(F.col("school_level") == 2).alias("middle_schools"),
        count_when(F.col("school_level") == 3).alias("high_schools"),
    )
    base = schools.where(yr == base_year).groupBy("zip_code").agg(
        F.sum("enrollment").alias("total_enrollment_5yr"),
        rounded_avg("student_teacher_ratio", 1).alias("student_teacher_ratio_5yr_ago"),
    )
    j = cur.join(base, "zip_code", "left")
    tot, tot5 = F.col("total_enrollment"), F.col("total_enrollment_5yr")
    j = j.withColumn("enrollment_change_5yr_pct", tie_safe_round(safe_div(tot - tot5, tot5) * 100, 1)) \
         .withColumn("str_change_5yr", tie_safe_round(F.col("avg_student_teacher_ratio") - F.col("student_teacher_ratio_5yr_ago"), 1))
    scored = percent_rank_scores(j, {"str_score": ("avg_student_teacher_ratio", False), "choice_score": ("school_count", True)})
    diversity = L.level_diversity("primary_schools", "middle_schools", "high_schools")
    scored = scored.withColumn("_div", diversity)
    score = weighted_score([(as_score(F.col("str_score")), "0.40"), (as_score(F.col("choice_score")), "0.30"), (F.col("_div"), "0.30")])
    return scored.select(
        "zip_code", "city", "state", "school_count", "total_enrollment", "avg_student_teacher_ratio",
        "avg_free_lunch_pct", "charter_count", "magnet_count", "primary_schools", "middle_schools", "high_schools",
        "enrollment_change_5yr_pct", "str_change_5yr", "student_teacher_ratio_5yr_ago",
        "str_score", "choice_score", F.col("_div").cast("double").alias("level_diversity_score"),
        score.alias("school_score"),
        L.tier(score).alias("school_tier"),
        L.school_trend(F.col("str_change_5yr"), F.col("enrollment_change_5yr_pct")).alias("school_trend"),
    )
