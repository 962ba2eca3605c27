"""Checks counted while a table is written, bucketed layers, and the rewriting of single months."""

import pytest
from pyspark.sql import functions as F

from areascope.operators import quality as Q
from areascope.plans import marts
from areascope.plans.checks import declared, stored_checks
from areascope.plans.layers import Layers
from areascope.registry import layers
from areascope.session import store

SF = "/root/testdata/sf0.001"


def counted(spark, df):
    """``df`` and an accumulator of the rows that were read from it, however often."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


@pytest.mark.parametrize("how", [{}, {"partition_by": ("p",)}, {"bucket_by": ("k",), "buckets": 3}])
def test_row_checks_cost_no_scan(spark, how):
    rows = [(i if i % 5 else None, "a" if i % 3 else "z", i % 4) for i in range(100)]
    df, seen = counted(spark, spark.createDataFrame(rows, "k int, c string, p int"))
    checks = [Q.not_null("k"), Q.accepted_values("c", ["a"]), Q.not_null("c"), Q.unique("p")]
    kept = store(df, "checked", metrics=Q.observed_checks(checks), **how)
    found = Q.observed_violations("m", checks, kept.metrics, kept.df)
    assert seen.value == 100
    assert [f[3] for f in found] == [20, 34, 0, 4] and kept.df.count() == 100
    exp = {(r.column_name, r.test): r.violations for r in Q.run_checks("m", kept.df, checks).collect()}
    assert exp == {(c, t): n for _, c, t, n in found}


def test_empty_table_has_no_violations(spark):
    checks = [Q.not_null("k"), Q.unique("k")]
    kept = store(spark.createDataFrame([], "k int"), "checked", metrics=Q.observed_checks(checks))
    assert [f[3] for f in Q.observed_violations("m", checks, kept.metrics, kept.df)] == [0, 0]


def test_a_failed_check_stops_the_build(spark):
    raw = layers(spark, SF)
    tables = [raw.raw_home_values, raw.raw_rental_prices, raw.raw_amenities, raw.raw_schools]
    bad = {**stored_checks(raw=False), "int_rental_yield": declared([("zip_code", "not_null"), ("yield_tier", "accepted_values", ("none",))])}
    p = Layers(spark, *tables, checks=bad, stop=True)
    with pytest.raises(Q.CheckFailed, match="int_rental_yield.yield_tier: accepted_values fails on"):
        p.market_intelligence
    assert "int_price_trends" in p.stored and "market_intelligence" not in p.stored and "int_neighborhood_score" not in p.stored
    good = Layers(spark, *tables, checks=stored_checks(raw=False), stop=True)
    assert good.area_comparison.count() > 0 and not any(f[3] for fs in good.violations.values() for f in fs)


def test_marts_join_bucketed_layers_without_exchange(spark):
    p = layers(spark, SF)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = marts.assemble(p.price_trends, p.rental_yield, p.neighborhood_score, p.school_score)
        plan = m._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("SortMergeJoin") >= 3 and "Exchange" not in plan
    assert m.count() == p.price_trends.count()
