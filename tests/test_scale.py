"""Operators for groups of any size against plain computations."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from areascope.operators.bitmaps import distinct_bitmaps, distinct_over
from areascope.operators.hotjoin import expanding_join
from areascope.operators.selection import exact_quantile


def test_bitmaps_add_up(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.randrange(4), r.choice([0, 5, 32767, 32768, 70_000, 2**40, None, r.randrange(100_000)])) for _ in range(2000)]
    cells = distinct_bitmaps(spark.createDataFrame(rows, "m string, t int, id long"), ["m", "t"], "id")
    for by in ([], ["m"], ["m", "t"], ["t"]):
        got = {tuple(x[c] for c in by): x["n"] for x in distinct_over(cells, by).collect()}
        exp = defaultdict(set)
        for m, t, i in rows:
            if i is not None:
                exp[tuple({"m": m, "t": t}[c] for c in by)].add(i)
        assert got == {k: len(v) for k, v in exp.items()}
    assert cells.where("bits is null").count() == 0
    with pytest.raises(Exception, match="negative"):
        distinct_bitmaps(spark.createDataFrame([("a", 1, -1)], "m string, t int, id long"), ["m"], "id").collect()
    assert distinct_over(distinct_bitmaps(spark.createDataFrame([], "m string, id long"), ["m"], "id"), ["m"]).count() == 0


NAN = float("nan")


@pytest.mark.parametrize("q", [0.5, 0.9, 0.001, 1.0])
@pytest.mark.parametrize("ways", [2, 7])
def test_exact_quantile(spark, q, ways):
    r = random.Random(q)
    groups = {"one": [5.0], "two": [1.0, 2.0], "ties": [3.0] * 50 + [1.0] * 20, "none": [None, None], None: [r.gauss(0, 1e6) for _ in range(301)],
              "nan": [NAN, 1.0, None, NAN, 2.0], "wide": [math.exp(r.uniform(-600, 600)) * r.choice((1, -1)) for _ in range(400)], "inf": [math.inf, -math.inf, 0.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {x["g"]: x["x"] for x in exact_quantile(df, ["g"], "v", q, "x", ways=ways).collect()}
    exp = {}
    for g, vs in groups.items():
        vs = sorted((v for v in vs if v is not None), key=lambda v: (math.isnan(v), 0 if math.isnan(v) else v))
        if vs:
            exp[g] = vs[max(1, math.ceil(len(vs) * q)) - 1]
    assert got.keys() == exp.keys() and all(got[g] == exp[g] or (math.isnan(got[g]) and math.isnan(exp[g])) for g in exp)


def test_exact_quantile_of_long_integers(spark):
    """Neighbours that a double cannot tell apart, far more values than the sketch is exact for."""
    base = 2**60
    df = spark.range(20_001).select((F.col("id") + base).alias("v"), F.lit(1).alias("g"))
    assert exact_quantile(df, ["g"], "v", 0.5, "x").first()["x"] == base + 10_000
    assert exact_quantile(df.limit(0), ["g"], "v").count() == 0


def test_hot_key_is_dealt_evenly(spark):
    """A city with a third of the facts and many postal codes: same rows as a plain join, tasks of like size."""
    facts = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 100)).alias("city"))
    facts = facts.unionAll(spark.createDataFrame([(-1, None), (-2, "nowhere")], "id long, city string"))
    zips = spark.range(400).select(F.when(F.col("id") < 100, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 100)).alias("city"), F.col("id").alias("zip"))
    out = expanding_join(facts, zips, ["city"], part_rows=5000)
    plain = facts.join(zips, ["city"])
    assert Counter(map(tuple, out.select("city", "id", "zip").collect())) == Counter(map(tuple, plain.select("city", "id", "zip").collect()))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(before, ("-1", "false", "32")):
            spark.conf.set(k, v)
        sizes = lambda df: max(r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
        assert sizes(plain) >= 100_000 and sizes(expanding_join(facts, zips, ["city"], part_rows=5000)) < 40_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
