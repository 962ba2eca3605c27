"""The raw school table is shuffled before its rows are wide."""

import glob

from areascope.plans import layers as LY
from areascope.session import store
from areascope.sources import adapter

SF = "/root/testdata/sf0.001"


def folder(path):
    return path.removeprefix("file:")


def test_years_are_brought_together_before_schools_get_their_names(spark, monkeypatch):
    plan = adapter.raw_schools(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan and "School " not in plan.split("RebalancePartitions")[1]
    seen, kept = {}, LY.store
    monkeypatch.setattr(LY, "store", lambda df, name, **how: seen.setdefault(name, how) and kept(df, name, **how))
    p = LY.Layers.from_benchmark(spark, SF)
    assert p.raw_schools.count() == adapter.raw_schools(spark, SF).count()
    assert seen["raw_schools"]["rebalance"] is False and seen["raw_schools"]["partition_by"] == ("year",)


def test_a_partitioned_write_can_leave_rows_where_they_are(spark):
    df = spark.range(0, 600, 1, 3).selectExpr("id", "cast(2017 + 5 * (id % 2) AS int) AS year")
    stored = store(df, "as-they-come", partition_by=("year",), rebalance=False)
    assert all(len(glob.glob(f"{folder(stored.path)}/year={y}/*.parquet")) == 3 for y in (2017, 2022)) and stored.df.count() == 600
