"""The distributed rank / percent_rank must equal Spark's window functions exactly, including
ties, nulls in both directions, one- and two-row inputs, null partitions and a hot partition."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from areascope.functions.numeric import tie_safe_round
from areascope.operators.ranking import percent_rank_scores, rank_within


def _rows(n, seed, null_share=0.1, distinct=50):
    rnd = random.Random(seed)
    return [(i, None if rnd.random() < null_share else float(rnd.randint(0, distinct)), rnd.choice(["a", "b", None]))
            for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 500])
@pytest.mark.parametrize("buckets", [2, 4, 512])
def test_percent_rank_matches_window(spark, n, buckets):
    df = spark.createDataFrame(_rows(n, n), "id long, v double, g string")
    got = percent_rank_scores(df, {"asc_s": ("v", True), "desc_s": ("v", False), "raw": ("v", True, None)},
                              buckets=buckets)
    exp = df.select(
        "id",
        tie_safe_round(F.percent_rank().over(Window.orderBy(F.col("v").asc())) * 100, 1).alias("asc_s"),
        tie_safe_round(F.percent_rank().over(Window.orderBy(F.col("v").desc())) * 100, 1).alias("desc_s"),
        F.percent_rank().over(Window.orderBy(F.col("v").asc())).alias("raw"),
    )
    assert sorted(got.select("id", "asc_s", "desc_s", "raw").collect()) == sorted(exp.collect())


def test_percent_rank_all_null(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, v double")
    got = percent_rank_scores(df, {"s": ("v", True), "d": ("v", False)})
    assert sorted(tuple(r) for r in got.select("id", "s", "d").collect()) == [(1, 0.0, 0.0), (2, 0.0, 0.0)]


@pytest.mark.parametrize("descending", [True, False])
def test_rank_within_matches_window_with_hot_and_null_partitions(spark, descending):
    rnd = random.Random(7)
    rows = []
    for i in range(900):
        g = "hot" if i % 3 == 0 else rnd.choice(["x", "y", None])   # one partition holds a third of the rows
        v = None if rnd.random() < 0.05 else rnd.randint(0, 40) / 2
        rows.append((i, g, v))
    df = spark.createDataFrame(rows, "id long, g string, v double")
    got = rank_within(df, "g", "v", out="r", descending=descending, buckets=8)
    order = F.col("v").desc() if descending else F.col("v").asc()
    exp = df.select("id", F.rank().over(Window.partitionBy("g").orderBy(order)).alias("r"))
    assert sorted(got.select("id", "r").collect()) == sorted(exp.collect())
    assert dict(got.dtypes)["r"] == "int"


def test_rank_within_decimal_order_key(spark):
    df = spark.createDataFrame([(1, "m", "10.05"), (2, "m", "10.050"), (3, "m", "10.049"), (4, "n", "1")],
                               "id long, g string, v string").withColumn("v", F.col("v").cast("decimal(10,3)"))
    got = {r.id: r.r for r in rank_within(df, "g", "v", out="r").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


NAN = float("nan")
TYPED = {
    "double": [1.0, NAN, None, NAN, -3.5, 2.0, float("inf"), None, 1.0],
    "bigint": [2**53, 2**53 + 1, 2**53 + 2, None, -(2**62), 2**53 + 1, 0],
    "date": ["2020-01-31", "1969-07-20", None, "2020-01-31", "2024-02-29"],
    "string": ["b", "abcdefgh", "abcdefgi", "", None, "é", "b"],
    "timestamp": ["2020-01-31 10:00:00", "2020-01-31 10:00:00.000001", None],
    "boolean": [True, False, None, True],
}


@pytest.mark.parametrize("dtype", sorted(TYPED))
@pytest.mark.parametrize("descending", [True, False])
def test_every_type_ranks_like_the_window(spark, dtype, descending):
    values = TYPED[dtype]
    source = "string" if dtype in ("date", "timestamp") else dtype
    df = spark.createDataFrame(list(enumerate(values)), f"id long, v {source}").withColumn("v", F.col("v").cast(dtype))
    order = F.col("v").desc() if descending else F.col("v").asc()
    w = Window.orderBy(order)
    exp = sorted(tuple(r) for r in df.select("id", F.rank().over(w), F.percent_rank().over(w)).collect())
    got = percent_rank_scores(df.withColumn("g", F.lit("x")), {"p": ("v", not descending, None)}, buckets=4)
    got = rank_within(got, "g", "v", out="r", descending=descending, buckets=4)
    assert sorted(tuple(r) for r in got.select("id", "r", "p").collect()) == exp


def test_hot_null_key_is_spread(spark):
    """A third of the values null, a third equal: the join back has a salt, so neither is one key."""
    rows = [(i, None if i % 3 == 0 else 5.0 if i % 3 == 1 else float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, v double")
    got = percent_rank_scores(df, {"s": ("v", False, None)}, reuse_input=False)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "pmod" in plan
    w = Window.orderBy(F.col("v").desc())
    assert sorted(tuple(r) for r in got.select("id", "s").collect()) == sorted(
        tuple(r) for r in df.select("id", F.percent_rank().over(w)).collect())


def test_no_window_over_all_rows(spark):
    """Before anything is stored: every window has a PARTITION BY, and no exchange gathers one partition."""
    df = spark.createDataFrame(_rows(200, 3), "id long, v double, g string")
    for out in (percent_rank_scores(df, {"s": ("v", True)}, reuse_input=False), rank_within(df, "g", "v", reuse_input=False)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "SinglePartition" not in plan
