"""One-pass lookback vs the reference-shaped self-joins; month-end alignment; missing history."""

import datetime as dt

from pyspark.sql import functions as F

from areascope.operators.panel import at_latest, common_latest, latest_date, lookback, self_join_lookback
from areascope.plans.intermediate import price_trends, rental_yield

OFFSETS = {"value_30d_ago": 1, "value_6m_ago": 6, "value_1yr_ago": 12}


def _panel(spark, rows):
    return spark.createDataFrame(rows, "zip_code string, date date, home_value double")


def _month_start_panel(spark):
    rows = []
    for z, start in (("00601", 0), ("10001", 0), ("20002", 14)):   # 20002 has no 1-year history
        for m in range(start, 25):
            d = dt.date(2000 + m // 12, m % 12 + 1, 1)
            rows.append((z, d, 100.0 + m + (0 if z != "10001" else 7)))
    return _panel(spark, rows)


def test_one_pass_equals_self_join(spark):
    p = _month_start_panel(spark)
    ref = latest_date(p)
    got = lookback(p, "zip_code", "home_value", ref, OFFSETS).drop()
    exp = self_join_lookback(p, "zip_code", "home_value", OFFSETS)
    cols = ["zip_code", "current_value", *OFFSETS]
    assert sorted(got.select(cols).collect()) == sorted(exp.select(cols).collect())
    no_hist = got.where("zip_code = '20002'").first()
    assert no_hist.value_1yr_ago is None and no_hist.value_6m_ago is not None


def test_month_end_panel_exact_vs_month_alignment(spark):
    # month-end dates ending 30 April: add_months keeps day 30, so March 31 / Oct 31 are missed
    ends = [dt.date(2025, 4, 30), dt.date(2025, 10, 31), dt.date(2026, 3, 31), dt.date(2026, 4, 30)]
    p = _panel(spark, [("00601", d, 100.0 + i) for i, d in enumerate(ends)])
    exact = lookback(p, "zip_code", "home_value", latest_date(p), OFFSETS).first()
    assert (exact.value_30d_ago, exact.value_6m_ago, exact.value_1yr_ago) == (None, None, 100.0)
    month = lookback(p, "zip_code", "home_value", latest_date(p), OFFSETS, align="month").first()
    assert (month.value_30d_ago, month.value_6m_ago, month.value_1yr_ago) == (102.0, 101.0, 100.0)


def test_at_latest_and_common_latest(spark):
    p = _month_start_panel(spark)
    assert at_latest(p).count() == 3
    rents = p.where(F.col("date") < dt.date(2001, 12, 1))
    assert spark.range(1).select(common_latest([rents, p])).first()[0] == dt.date(2001, 11, 1)


def test_price_trends_labels_no_history_as_strong_decline(spark):
    p = _month_start_panel(spark).withColumn("city", F.lit("c")).withColumn("state", F.lit("S")) \
        .withColumn("state_name", F.lit("S")).withColumn("metro", F.lit(None).cast("string")).withColumn("county", F.lit("k"))
    out = {r.zip_code: r for r in price_trends(p).collect()}
    assert out["20002"].price_trend == "strong_decline" and out["20002"].price_momentum == "decelerating"
    assert out["00601"].as_of_date == dt.date(2002, 1, 1)
    assert out["00601"].pct_change_1yr == round((124 - 112) / 112 * 100 + 1e-9, 2)


def test_rental_yield_uses_earlier_common_date(spark):
    hv = _month_start_panel(spark).withColumn("city", F.lit("c")).withColumn("state", F.lit("S")) \
        .withColumn("metro", F.lit("M"))
    rents = (hv.where(F.col("date") < dt.date(2001, 12, 1)).where("zip_code <> '10001'")
             .withColumn("rental_price", F.col("home_value") / 100).drop("home_value"))
    out = {r.zip_code: r for r in rental_yield(rents, hv).collect()}
    assert set(out) == {"00601", "20002"}      # no rent -> no row
    r = out["00601"]
    assert r.as_of_date == dt.date(2001, 11, 1)
    assert r.current_yield == round(r.current_rent * 12 / r.current_value * 100 + 1e-9, 2)
    assert r.yield_tier == "premium" and r.yield_trend == "stable"
