"""Panel and ranking operators: reference dates, lookbacks, percent_rank, rank within groups (J-01..J-05, W-01..W-05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from areascope import oracle as O
from areascope.operators.panel import at_latest, common_latest, lookback
from areascope.operators.ranking import percent_rank_scores, rank_within
from areascope.queries.base import layers, register
from areascope.sources import adapter as AD


@register("rows_at_latest", O.with_models("""
SELECT * FROM stg_home_values WHERE date = (SELECT max(date) FROM stg_home_values)"""))
def q_rows_at_latest(spark, sf_dir):
    return at_latest(layers(spark, sf_dir).stg_home_values)


@register("common_latest", O.with_models("""
SELECT min(max_date) AS ref_date FROM (SELECT max(date) AS max_date FROM stg_rental_prices
                                       UNION ALL SELECT max(date) AS max_date FROM stg_home_values)"""))
def q_common_latest(spark, sf_dir):
    p = layers(spark, sf_dir)
    return spark.range(1).select(common_latest([p.stg_rental_prices, p.stg_home_values]).alias("ref_date"))


_SPARSE_PANEL = f"""
sparse_panel AS (SELECT {O.zip5("area")} AS zip_code, date, home_value FROM ({O.cells("l_partkey")})),
sparse_lookback AS ({O.lookbacks("sparse_panel")})"""

_LOOKBACK_NAMES = {"value_30d_ago": 1, "value_6m_ago": 6, "value_1yr_ago": 12}


@register("lookback_1_6_12", O.with_models(O.lookbacks("stg_home_values")))
def q_lookback(spark, sf_dir):
    hv = layers(spark, sf_dir).stg_home_values
    return lookback(hv, "zip_code", "home_value", hv.select(F.max("date")).scalar(), _LOOKBACK_NAMES)


def _sparse_lookback(spark, sf_dir):
    p = AD.sparse_value_panel(spark, sf_dir)
    # a literal reference date, read from the ship dates alone, lets the date filter sink below the
    # lineitem aggregation, which then runs once
    return lookback(p, "zip_code", "home_value", AD.last_month(spark, sf_dir), _LOOKBACK_NAMES)


@register("lookback_sparse", f"WITH {_SPARSE_PANEL} SELECT * FROM sparse_lookback")
def q_lookback_sparse(spark, sf_dir):
    """Part-keyed panel: most lookbacks find no row and stay null."""
    return _sparse_lookback(spark, sf_dir)


@register("percentile_scores", f"""WITH {_SPARSE_PANEL}
SELECT zip_code, current_value, value_1yr_ago, {O.percentile("current_value", "current_pct")},
       {O.percentile("value_1yr_ago", "past_pct_asc")}, {O.percentile("value_1yr_ago", "past_pct_desc", True)},
       percent_rank() OVER (ORDER BY value_6m_ago DESC NULLS LAST) AS six_month_fraction
FROM sparse_lookback""")
def q_percentile_scores(spark, sf_dir):
    """Global percent_rank in both directions over a column that is mostly null."""
    lb = _sparse_lookback(spark, sf_dir).select("zip_code", "current_value", "value_1yr_ago", "value_6m_ago")
    scored = percent_rank_scores(lb, {"current_pct": ("current_value", True), "past_pct_asc": ("value_1yr_ago", True),
                                      "past_pct_desc": ("value_1yr_ago", False),
                                      "six_month_fraction": ("value_6m_ago", False, None)})
    return scored.drop("value_6m_ago")


@register("value_rank_by_month", O.with_models("""
SELECT zip_code, date, home_value, CAST(rank() OVER (PARTITION BY date ORDER BY thousands DESC NULLS LAST) AS INTEGER) AS value_rank
FROM (SELECT *, round(home_value + 1e-9, -3) + 0.0 AS thousands FROM stg_home_values)"""))
def q_value_rank_by_month(spark, sf_dir):
    """rank() within every month of the panel (thousands rounded, so ties are common)."""
    hv = layers(spark, sf_dir).stg_home_values.select("zip_code", "date", "home_value")
    keyed = hv.withColumn("_k", F.round(F.col("home_value") + F.lit(1e-9), -3))
    return rank_within(keyed, "date", "_k", out="value_rank").drop("_k")
