"""Mart semantics on hand-made intermediate rows: defaults, null metro, ties in rank, signals."""

import datetime as dt

from pyspark.sql import functions as F

from areascope.plans.intermediate import neighborhood_score, school_score
from areascope.plans.marts import area_comparison, investment_hotspots, market_intelligence

D = dt.date(2026, 4, 30)


def _trends(spark):
    rows = [("1", "M", 2.0), ("2", "M", 2.0), ("3", None, None), ("4", "N", -20.0)]
    base = spark.createDataFrame(rows, "zip_code string, metro string, annual_appreciation_rate double")
    return base.select(
        "zip_code", F.lit("c").alias("city"), F.lit("S").alias("state"), F.lit("S").alias("state_name"), "metro",
        F.lit("k").alias("county"), F.lit(D).alias("as_of_date"), F.lit(100000.0).alias("current_value"),
        F.lit(None).cast("double").alias("pct_change_30d"), F.lit(None).cast("double").alias("pct_change_6m"),
        F.col("annual_appreciation_rate").alias("pct_change_1yr"), F.lit(0.0).alias("dollar_change_1yr"),
        "annual_appreciation_rate", F.lit("stable").alias("price_trend"), F.lit("decelerating").alias("price_momentum"))


def _yields(spark):
    return spark.createDataFrame([("1", 700.0, 8400.0, 8.4, -3.0, 1.0, "premium", "stable")],
                                 "zip_code string, current_rent double, annual_rent double, current_yield double, "
                                 "yield_change_1yr_bps double, rent_growth_1yr_pct double, yield_tier string, yield_trend string")


def _nbhd(spark):
    am = spark.createDataFrame([("1", "c", "S", cat) for cat in ("parks", "shopping", "entertainment", "dining")]
                               + [("2", "c", "S", "parks")], "zip_code string, city string, state_name string, amenity_category string")
    return neighborhood_score(am)


def _schools(spark):
    rows = [("1", "c", "S", 1, 100, 10.0, 5.0, 0, 0, 2022), ("1", "c", "S", 2, 100, 12.0, 5.0, 1, 0, 2022),
            ("1", "c", "S", 1, 150, 15.0, 5.0, 0, 0, 2017), ("2", "c", "S", 3, 80, None, None, 0, 1, 2022)]
    df = spark.createDataFrame(rows, "zip_code string, city string, state string, school_level int, enrollment int, "
                                     "student_teacher_ratio double, free_lunch_pct double, charter int, magnet int, year int")
    return school_score(df)


def test_market_defaults_and_ranks(spark):
    mi = market_intelligence(_trends(spark), _yields(spark), _nbhd(spark), _schools(spark))
    rows = {r.zip_code: r for r in mi.collect()}
    assert rows["3"].neighborhood_tier == "no_data" and rows["3"].school_score == 0.0
    # null appreciation scores 0 on price; missing yield 0; missing scores default to 50 in livability
    assert rows["3"].livability_score == 0 * 0.25 + 0 + 50 * 0.30 + 50 * 0.25
    assert rows["3"].livability_score is not None and rows["3"].metro_rank == 1
    assert rows["1"].metro_rank == 1 and rows["2"].metro_rank == 2
    assert rows["4"].livability_tier in ("D - Below Average", "C - Average")
    s2 = _schools(spark).where("zip_code = '2'").first()
    assert s2.str_score == 100.0 and s2.school_trend == "stable"   # null ratio sorts last on desc -> 100
    s1 = _schools(spark).where("zip_code = '1'").first()
    assert s1.enrollment_change_5yr_pct == round((200 - 150) / 150 * 100 + 1e-9, 1) and s1.level_diversity_score == 66.6


def test_investment_and_area(spark):
    mi = market_intelligence(_trends(spark), _yields(spark), _nbhd(spark), _schools(spark))
    inv = investment_hotspots(mi).collect()
    assert [r.zip_code for r in inv] == ["1"]
    assert inv[0].metro_investment_rank == 1 and inv[0].cash_on_cash_estimate == round(8400 / 25000 * 100 + 1e-9, 2)
    ac = {r.metro: r for r in area_comparison(mi).collect()}
    assert set(ac) == {"M", "N"}                    # null metro excluded
    assert ac["M"].zip_count == 2 and ac["M"].price_to_rent_ratio == round(100000 / 8400 + 1e-9, 1)
