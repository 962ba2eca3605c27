"""Plan assertions: the distributed rewrites keep the shapes they promise."""

from areascope.operators import ranking
from areascope.plans import intermediate, marts
from areascope.registry import layers
from areascope.session import materialize



def has_global_window(plan: str) -> bool:
    """True when a Window operator has no partition spec. Spark prints its expressions, its partition
    keys and its order, each in brackets, and leaves out an empty one; an order says ASC or DESC."""
    for line in plan.split("\n"):
        if "Window [" not in line:
            continue
        groups, depth, start = [], 0, 0
        for i, ch in enumerate(line):
            if ch == "[":
                start, depth = (i if depth == 0 else start), depth + 1
            elif ch == "]":
                depth -= 1
                if depth == 0:
                    groups.append(line[start:i])
        if len(groups) == 1 or " ASC" in groups[1] or " DESC" in groups[1]:
            return True
    return False


SF = "/root/testdata/sf0.001"


def _plan(df):
    df.collect()   # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def _unstored(spark, monkeypatch):
    """The models as plans in which nothing has been written yet."""
    monkeypatch.setattr(ranking, "materialize", lambda df, *a, **k: df)
    p = layers(spark, SF)
    market = marts.market_intelligence(p.price_trends, p.rental_yield, p.neighborhood_score, p.school_score)
    return {
        "price_trends": intermediate.price_trends(p.stg_home_values),
        "rental_yield": intermediate.rental_yield(p.stg_rental_prices, p.stg_home_values),
        "neighborhood_score": intermediate.neighborhood_score(p.stg_amenities),
        "school_score": intermediate.school_score(p.stg_schools),
        "market_intelligence": market,
        "investment_hotspots": marts.investment_hotspots(p.market_intelligence),
        "area_comparison": marts.area_comparison(p.market_intelligence),
    }


def _text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_model_plans(spark, monkeypatch):
    plans = {name: _text(df) for name, df in _unstored(spark, monkeypatch).items()}
    for name, plan in plans.items():
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
    for name in ("price_trends", "rental_yield"):   # one grouped pass: no self-joins, no windows
        assert "Aggregate" in plans[name] and "Join" not in plans[name] and "Window" not in plans[name]
    for name in ("neighborhood_score", "school_score", "market_intelligence", "investment_hotspots"):
        assert "Window [" in plans[name] and not has_global_window(plans[name]), "a window without PARTITION BY runs in one task"
    # distinct areas are counted beside the sketches, not inside them
    assert "Expand" not in plans["area_comparison"]


def test_staging_filter_reaches_the_scan(spark):
    for df, value in ((layers(spark, SF).stg_home_values, "home_value"), (layers(spark, SF).stg_rental_prices, "rental_price")):
        scan = next(line for line in _text(df).split("\n") if "FileScan" in line)
        assert f"GreaterThan({value},0.0)" in scan and "IsNotNull(zip_code)" in scan


def test_panels_share_one_scan_of_the_lines(spark):
    from areascope.sources.adapter import monthly_cells

    scans = [line for line in _text(monthly_cells(spark, SF)).split("\n") if "FileScan" in line]
    assert len(scans) == 1 and "l_comment" not in scans[0] and "l_partkey" not in scans[0]


def test_partitioned_write_has_several_tasks_for_each_folder(spark, tmp_path):
    """Two school years: a folder is written by more than one task when it is larger than the advisory size."""
    import glob

    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(60000).selectExpr("uuid() AS x", "cast(2017 + 5 * (id % 2) AS int) AS year")
        stored = materialize(df, "two-years", partition_by=("year",))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    path = stored.inputFiles()[0].removeprefix("file:").lstrip("/")
    root = "/" + path.rsplit("/year=", 1)[0]
    assert all(len(glob.glob(f"{root}/year={y}/*.parquet")) >= 2 for y in (2017, 2022))


def test_global_window_detector(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    g = spark.range(5).select(F.percent_rank().over(Window.orderBy("id")))
    p = spark.range(5).select(F.rank().over(Window.partitionBy(F.col("id") % 2).orderBy("id")))
    assert has_global_window(_plan(g)) and not has_global_window(_plan(p))


def test_lookback_prunes_month_partitions(spark):
    from areascope.plans.intermediate import price_trends

    p = layers(spark, SF)
    plan = price_trends(p.stg_home_values)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "raw_home_values" in line)
    assert "PartitionFilters: [" in scan and " IN (" in scan.split("PartitionFilters: [")[1]
