"""Report queries over the marts: dashboard tabs, documented SQL, widgets (R-02..R-17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from areascope import oracle as O
from areascope.plans import reports as R
from areascope.queries.base import layers, register
from areascope.sources import ingest as ING



# The parameters the registered report queries run with.
SEARCH_PARAMS = dict(price=(100_000, 150_000), min_livability=40, min_neighborhood=30, min_school=30, min_yield=5.0)
COMPARE_PATTERNS = ("%AMERICA%", "%ASIA%")


def _mi(spark, sf_dir):
    return layers(spark, sf_dir).market_intelligence


def _ih(spark, sf_dir):
    return layers(spark, sf_dir).investment_hotspots


def _ac(spark, sf_dir):
    return layers(spark, sf_dir).area_comparison


_SEARCH_WHERE = """home_value BETWEEN 100000 AND 150000 AND livability_score >= 40 AND neighborhood_score >= 30
  AND school_score >= 30 AND gross_rental_yield >= 5.0"""


@register("state_list", O.with_models("SELECT DISTINCT state FROM market_intelligence WHERE state IS NOT NULL"))
def q_state_list(spark, sf_dir):
    return R.state_list(_mi(spark, sf_dir))


@register("metro_list", O.with_models("""
SELECT DISTINCT metro FROM market_intelligence WHERE state IN ('NATION_1', 'NATION_2', 'NATION_3') AND metro IS NOT NULL"""))
def q_metro_list(spark, sf_dir):
    return R.metro_list(_mi(spark, sf_dir), ["NATION_1", "NATION_2", "NATION_3"])


@register("price_bounds", O.with_models("""
SELECT coalesce(CAST(trunc(min(home_value)) AS BIGINT), 0) AS min_price,
       least(coalesce(CAST(trunc(max(home_value)) AS BIGINT), 1000000), 2000000) AS slider_max,
       coalesce(CAST(trunc(min(home_value)) AS BIGINT), 0) AS default_low,
       least(500000, coalesce(CAST(trunc(max(home_value)) AS BIGINT), 1000000)) AS default_high
FROM market_intelligence"""))
def q_price_bounds(spark, sf_dir):
    return R.price_bounds(_mi(spark, sf_dir))


@register("buyer_search", O.with_models(f"SELECT * FROM market_intelligence WHERE {_SEARCH_WHERE}"))
def q_buyer_search(spark, sf_dir):
    return R.search(_mi(spark, sf_dir), **SEARCH_PARAMS)


@register("kpis", O.with_models(f"""
SELECT count(*) AS zip_codes, round(avg(home_value) + 1e-9, 0) + 0.0 AS avg_home_value,
       round(avg(monthly_rent) + 1e-9, 0) + 0.0 AS avg_monthly_rent, round(avg(gross_rental_yield) + 1e-9, 2) + 0.0 AS avg_rental_yield,
       round(avg(livability_score) + 1e-9, 1) + 0.0 AS avg_livability
FROM market_intelligence WHERE home_value BETWEEN 100000 AND 150000"""))
def q_kpis(spark, sf_dir):
    return R.kpis(R.search(_mi(spark, sf_dir), price=(100_000, 150_000)))


@register("top_zips", O.with_models("""
SELECT zip_code, city, state, metro, home_value, monthly_rent, gross_rental_yield, price_change_1yr_pct,
       neighborhood_score, school_score, livability_score, livability_tier, metro_rank
FROM market_intelligence ORDER BY livability_score DESC NULLS LAST, zip_code LIMIT 50"""))
def q_top_zips(spark, sf_dir):
    return R.top_zips(R.search(_mi(spark, sf_dir)))


@register("livability_histogram", O.with_models("""
SELECT CAST(CASE WHEN b.hi = b.lo THEN 0 ELSE least(floor((m.livability_score - b.lo) / ((b.hi - b.lo) / 30.0::DOUBLE)), 29) END AS INTEGER) AS bin,
       m.livability_tier, count(*) AS zip_count, min(m.livability_score) AS bin_min_score, max(m.livability_score) AS bin_max_score
FROM market_intelligence m, (SELECT min(livability_score) AS lo, max(livability_score) AS hi FROM market_intelligence) b
WHERE m.livability_score IS NOT NULL GROUP BY 1, 2"""))
def q_livability_histogram(spark, sf_dir):
    return R.livability_histogram(_mi(spark, sf_dir))


@register("price_yield_sample", O.with_models("""
SELECT zip_code, city, state, home_value, gross_rental_yield, livability_tier FROM market_intelligence
WHERE home_value IS NOT NULL AND gross_rental_yield IS NOT NULL ORDER BY zip_code LIMIT 500"""))
def q_price_yield_sample(spark, sf_dir):
    return R.sample_rows(_mi(spark, sf_dir), ["home_value", "gross_rental_yield"], 500,
                         ["zip_code", "city", "state", "home_value", "gross_rental_yield", "livability_tier"])


@register("signal_counts", O.with_models("""
SELECT CAST(sum(CASE WHEN investment_signal = 'STRONG BUY' THEN 1 ELSE 0 END) AS BIGINT) AS strong_buy,
       CAST(sum(CASE WHEN investment_signal = 'BUY' THEN 1 ELSE 0 END) AS BIGINT) AS buy,
       CAST(sum(CASE WHEN investment_signal = 'HOLD' THEN 1 ELSE 0 END) AS BIGINT) AS hold,
       CAST(sum(CASE WHEN investment_signal = 'WATCH' THEN 1 ELSE 0 END) AS BIGINT) AS watch
FROM investment_hotspots"""))
def q_signal_counts(spark, sf_dir):
    return R.signal_counts(_ih(spark, sf_dir))


@register("signal_distribution", O.with_models(
    "SELECT investment_signal, count(*) AS count FROM investment_hotspots GROUP BY investment_signal"))
def q_signal_distribution(spark, sf_dir):
    return R.signal_distribution(_ih(spark, sf_dir))


@register("top_investments", O.with_models("""
SELECT zip_code, city, state, metro, home_value, monthly_rent, gross_rental_yield, annual_appreciation_rate,
       investment_score, cash_on_cash_estimate, investment_signal
FROM investment_hotspots ORDER BY investment_score DESC NULLS LAST, zip_code LIMIT 30"""))
def q_top_investments(spark, sf_dir):
    return R.top_by(_ih(spark, sf_dir), "investment_score", 30, R.TOP_INVESTMENT_COLS)


@register("yield_apprec_sample", O.with_models("""
SELECT zip_code, city, gross_rental_yield, annual_appreciation_rate, investment_signal, investment_score
FROM investment_hotspots ORDER BY zip_code LIMIT 300"""))
def q_yield_apprec_sample(spark, sf_dir):
    return R.sample_rows(_ih(spark, sf_dir), [], 300, ["zip_code", "city", "gross_rental_yield", "annual_appreciation_rate",
                                                        "investment_signal", "investment_score"])


_METRO_COLS_SQL = """metro, zip_count, median_home_value, avg_monthly_rent, avg_rental_yield, avg_appreciation_rate,
       avg_neighborhood_score, avg_school_score, avg_livability_score, pct_appreciating"""


@register("top_metros", O.with_models(f"""
SELECT {_METRO_COLS_SQL} FROM area_comparison ORDER BY avg_livability_score DESC NULLS LAST, metro LIMIT 20"""))
def q_top_metros(spark, sf_dir):
    return R.metro_ranking(_ac(spark, sf_dir), 20)


@register("metro_table", O.with_models(f"SELECT {_METRO_COLS_SQL} FROM area_comparison"))
def q_metro_table(spark, sf_dir):
    return R.metro_ranking(_ac(spark, sf_dir), None)


@register("metro_value_yield", O.with_models("""
SELECT metro, median_home_value, avg_rental_yield, zip_count FROM area_comparison
ORDER BY avg_livability_score DESC NULLS LAST, metro LIMIT 50"""))
def q_metro_value_yield(spark, sf_dir):
    return R.metro_ranking(_ac(spark, sf_dir), 50, ("metro", "median_home_value", "avg_rental_yield", "zip_count"))


@register("top_livable_metros_appreciation", O.with_models("""
SELECT metro, avg_appreciation_rate FROM area_comparison ORDER BY avg_livability_score DESC NULLS LAST, metro LIMIT 15"""))
def q_top_livable_metros_appreciation(spark, sf_dir):
    """The dashboard's 'top 15 by appreciation' chart: actually the 15 most livable metros."""
    return R.metro_ranking(_ac(spark, sf_dir), 15, ("metro", "avg_appreciation_rate"))


@register("trend_counts", O.with_models("SELECT price_trend, count(*) AS count FROM market_intelligence GROUP BY price_trend"))
def q_trend_counts(spark, sf_dir):
    return R.trend_counts(_mi(spark, sf_dir))


@register("yield_tier_counts", O.with_models(
    "SELECT yield_tier, count(*) AS count FROM market_intelligence WHERE yield_tier IS NOT NULL GROUP BY yield_tier"))
def q_yield_tier_counts(spark, sf_dir):
    return R.yield_tier_counts(_mi(spark, sf_dir))


@register("score_overlap_sample", O.with_models("""
SELECT zip_code, city, state, neighborhood_score, school_score, livability_tier FROM market_intelligence
WHERE neighborhood_score IS NOT NULL AND school_score IS NOT NULL ORDER BY zip_code LIMIT 500"""))
def q_score_overlap_sample(spark, sf_dir):
    return R.sample_rows(_mi(spark, sf_dir), ["neighborhood_score", "school_score"], 500,
                         ["zip_code", "city", "state", "neighborhood_score", "school_score", "livability_tier"])


@register("doc_q1_top_livable", O.with_models("""
SELECT zip_code, city, state, metro, home_value, monthly_rent, gross_rental_yield, neighborhood_score, school_score,
       livability_score, livability_tier, metro_rank
FROM market_intelligence ORDER BY livability_score DESC NULLS LAST, zip_code LIMIT 10"""))
def q_doc_q1(spark, sf_dir):
    return R.doc_top_livable(_mi(spark, sf_dir))


@register("doc_q2_strong_buys", O.with_models("""
SELECT zip_code, city, state, metro, home_value, monthly_rent, gross_rental_yield, annual_appreciation_rate,
       investment_score, cash_on_cash_estimate, investment_signal
FROM investment_hotspots WHERE investment_signal = 'STRONG BUY'
ORDER BY investment_score DESC NULLS LAST, zip_code LIMIT 10"""))
def q_doc_q2(spark, sf_dir):
    return R.doc_strong_buys(_ih(spark, sf_dir))


@register("doc_q3_compare_metros", O.with_models(f"""
SELECT {_METRO_COLS_SQL} FROM area_comparison WHERE metro LIKE '%AMERICA%' OR metro LIKE '%ASIA%'"""))
def q_doc_q3(spark, sf_dir):
    return R.doc_compare_metros(_ac(spark, sf_dir), COMPARE_PATTERNS)


@register("doc_q4_affordable_schools", O.with_models("""
SELECT zip_code, city, state, metro, home_value, school_score, school_tier, livability_score
FROM market_intelligence WHERE home_value < 300000 AND school_score >= 70
ORDER BY livability_score DESC NULLS LAST, zip_code LIMIT 20"""))
def q_doc_q4(spark, sf_dir):
    return R.doc_affordable_good_schools(_mi(spark, sf_dir))


@register("doc_q5_high_yield", O.with_models("""
SELECT zip_code, city, state, home_value, gross_rental_yield, price_change_1yr_pct, investment_signal
FROM investment_hotspots WHERE gross_rental_yield >= 8 AND annual_appreciation_rate > 3"""))
def q_doc_q5(spark, sf_dir):
    return R.doc_high_yield_appreciating(_ih(spark, sf_dir))


@register("widget_zip_count", O.with_models("SELECT count(*) AS zip_codes FROM market_intelligence"))
def q_widget_zip_count(spark, sf_dir):
    return _mi(spark, sf_dir).agg(F.count(F.lit(1)).alias("zip_codes"))


@register("widget_yield_by_metro", O.with_models("""
SELECT metro, round(avg(gross_rental_yield) + 1e-9, 2) + 0.0 AS avg_rental_yield FROM market_intelligence
WHERE metro IS NOT NULL GROUP BY metro"""))
def q_widget_yield_by_metro(spark, sf_dir):
    return R.metro_averages(_mi(spark, sf_dir), "gross_rental_yield", "avg_rental_yield", 2)


@register("widget_livability_by_metro", O.with_models("""
SELECT metro, round(avg(livability_score) + 1e-9, 1) + 0.0 AS avg_livability_score FROM market_intelligence
WHERE metro IS NOT NULL GROUP BY metro"""))
def q_widget_livability_by_metro(spark, sf_dir):
    return R.metro_averages(_mi(spark, sf_dir), "livability_score", "avg_livability_score", 1)


@register("widget_zips_by_tier", O.with_models(
    "SELECT livability_tier, count(*) AS count FROM market_intelligence GROUP BY livability_tier"))
def q_widget_zips_by_tier(spark, sf_dir):
    return R.zips_by_tier(_mi(spark, sf_dir))


# ------------------------------------------------------------------ selections and limits that cut
_PLACES = dict(states=["NATION_1", "NATION_4", "NATION_9"], metros=["AMERICA", "ASIA", "AFRICA"])
_PLACES_SQL = "state IN ('NATION_1', 'NATION_4', 'NATION_9') AND metro IN ('AMERICA', 'ASIA', 'AFRICA')"


@register("search_places", O.with_models(f"SELECT zip_code, state, metro, livability_score FROM market_intelligence WHERE {_PLACES_SQL}"))
def q_search_places(spark, sf_dir):
    return R.search(_mi(spark, sf_dir), **_PLACES).select("zip_code", "state", "metro", "livability_score")


@register("signal_counts_places", O.with_models(f"""
SELECT {", ".join(O.hits(f"investment_signal = '{s}'", n) for s, n in (("STRONG BUY", "strong_buy"), ("BUY", "buy"), ("HOLD", "hold"), ("WATCH", "watch")))}
FROM investment_hotspots WHERE {_PLACES_SQL}"""))
def q_signal_counts_places(spark, sf_dir):
    return R.signal_counts(_ih(spark, sf_dir), **_PLACES)


@register("top_two_metros", O.with_models("""
SELECT metro, avg_livability_score FROM area_comparison ORDER BY avg_livability_score DESC NULLS LAST, metro LIMIT 2"""))
def q_top_two_metros(spark, sf_dir):
    return R.metro_ranking(_ac(spark, sf_dir), 2, ["metro", "avg_livability_score"])


@register("price_yield_head", O.with_models("""
SELECT zip_code, home_value, gross_rental_yield FROM market_intelligence
WHERE home_value IS NOT NULL AND gross_rental_yield IS NOT NULL ORDER BY zip_code LIMIT 3"""))
def q_price_yield_head(spark, sf_dir):
    return R.sample_rows(_mi(spark, sf_dir), ["home_value", "gross_rental_yield"], 3, ["zip_code", "home_value", "gross_rental_yield"])


@register("top_five_cities", O.with_models("""
SELECT city, state, state_name, count(DISTINCT zip_code) AS zip_count
FROM raw_home_values WHERE city IS NOT NULL AND state IS NOT NULL GROUP BY city, state, state_name
ORDER BY zip_count DESC, city, state LIMIT 5"""))
def q_top_five_cities(spark, sf_dir):
    return ING.top_cities(ING.city_zip_sets(layers(spark, sf_dir).raw_home_values), 5).select("city", "state", "state_name", "zip_count")
