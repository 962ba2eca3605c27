"""Column helpers: rounding, key cleaning, labels at their exact boundaries."""

from decimal import Decimal

from pyspark.sql import functions as F

from areascope.functions import labels as L
from areascope.functions.keys import pad_zip, school_zip, zip5
from areascope.functions.numeric import money_change, scale_clip, tie_safe_round, weighted_score
from areascope.sources.ingest import derive_school_ratios


def one(spark, expr, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_tie_safe_round_rounds_ties_away_from_zero(spark):
    out = one(spark, tie_safe_round(F.col("x"), 2), "x double", [(1.005,), (2.675,), (0.125,), (-1.015,), (-0.125,), (None,)])
    assert out == [1.01, 2.68, 0.13, -1.02, -0.13, None]
    assert one(spark, tie_safe_round(F.col("x"), 0), "x double", [(-1234.5,), (1234.5,), (0.0,)]) == [-1235.0, 1235.0, 0.0]


def test_money_change_is_exact(spark):
    rows = [(100000.25, 101094.75), (101094.75, 100000.25), (None, 1.0)]
    assert one(spark, money_change(F.col("a"), F.col("b")), "a double, b double", rows) == [-1095.0, 1095.0, None]


def test_school_ratios_round_half_to_even(spark):
    df = spark.createDataFrame([(49, 4.0, 0), (47, 4.0, 0), (8, 0.0, 1), (None, 2.0, 3)], "enrollment int, teachers_fte double, free_lunch int")
    out = derive_school_ratios(df).select("student_teacher_ratio", "free_lunch_pct").collect()
    assert [r[0] for r in out] == [12.2, 11.8, None, 0.0] and out[2][1] == 12.5 and out[3][1] is None


def test_pad_zip_never_truncates(spark):
    out = one(spark, pad_zip(F.col("z")), "z string", [("601",), ("12345",), ("123456",), (None,)])
    assert out == ["00601", "12345", "123456", None]


def test_zip5_and_school_zip(spark):
    assert one(spark, zip5(F.col("z")), "z string", [("12345-6789",), ("601",)]) == ["12345", "601"]
    rows = [("601-1234", "99999"), (None, "2345"), (None, None), ("", "77777")]
    out = one(spark, school_zip(F.col("m"), F.col("l")), "m string, l string", rows)
    assert out == ["00601", "02345", None, None]


def test_price_trend_is_strict_and_null_falls_through(spark):
    rows = [(0.0500001,), (0.05,), (0.01,), (-0.01,), (-0.05,), (-0.0500001,), (None,)]
    out = one(spark, L.price_trend(F.col("r")), "r double", rows)
    assert out == ["strong_appreciation", "moderate_appreciation", "stable", "moderate_decline", "strong_decline",
                   "strong_decline", "strong_decline"]


def test_tiers_are_inclusive(spark):
    out = one(spark, L.tier(F.col("s")), "s double", [(80.0,), (79.9,), (60.0,), (40.0,), (20.0,), (19.9,), (None,)])
    assert out == ["excellent", "good", "good", "average", "below_average", "poor", "poor"]
    out = one(spark, L.yield_tier(F.col("y")), "y double", [(8.0,), (6.0,), (4.0,), (2.0,), (1.99,)])
    assert out == ["premium", "strong", "average", "below_average", "low"]


def test_school_trend_and_signal(spark):
    rows = [(-1.1, 1.0), (-1.0, 5.0), (1.1, -0.1), (None, 3.0)]
    assert one(spark, L.school_trend(F.col("s"), F.col("e")), "s double, e double", rows) == \
        ["improving", "stable", "declining", "stable"]
    rows = [(6.0, 2.1, 50.0), (6.0, 2.0, 50.0), (4.0, 0.1, 30.0), (3.0, -1.9, 0.0), (3.0, None, 0.0)]
    assert one(spark, L.investment_signal(F.col("y"), F.col("a"), F.col("n")), "y double, a double, n double", rows) == \
        ["STRONG BUY", "BUY", "BUY", "HOLD", "WATCH"]


def test_level_diversity_and_weighted_score_are_exact(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (0, 0, 2)], "p int, m int, h int")
    assert [float(r[0]) for r in df.select(L.level_diversity("p", "m", "h")).collect()] == [100.0, 33.3, 33.4]
    # 12.5*0.30 + 12.5*0.20 + 12.5*0.25 + 12.7*0.25 = 12.55 exactly -> 12.6 (half-up on the exact decimal)
    df = spark.createDataFrame([(12.5, 12.5, 12.5, 12.7)], "a double, b double, c double, d double")
    score = weighted_score([(F.col("a").cast("decimal(6,1)"), "0.30"), (F.col("b").cast("decimal(6,1)"), "0.20"),
                            (F.col("c").cast("decimal(6,1)"), "0.25"), (F.col("d").cast("decimal(6,1)"), "0.25")])
    assert df.select(score).first()[0] == 12.6


def test_scale_clip_null_is_zero_and_clamps(spark):
    rows = [(None,), (-15.0,), (0.0,), (2.5,), (12.0,)]
    out = one(spark, scale_clip(F.col("x"), -10, 10), "x double", rows)
    assert out == [Decimal("0.00"), Decimal("0.00"), Decimal("50.00"), Decimal("62.50"), Decimal("100.00")]


def test_classify_amenity_rule_order(spark):
    rows = [({"leisure": "park", "shop": "mall"},), ({"shop": "bakery"},), ({"amenity": "marketplace"},),
            ({"leisure": "fitness_centre"},), ({"tourism": "museum"},), ({"amenity": "fast_food"},),
            ({"amenity": "bank"},), ({"shop": ""},)]
    df = spark.createDataFrame(rows, "tags map<string,string>")
    cat, kind = L.classify_amenity(F.col("tags"))
    out = [tuple(r) for r in df.select(cat, kind).collect()]
    assert out == [("parks", "park"), ("shopping", "bakery"), ("shopping", "marketplace"),
                   ("entertainment", "fitness_centre"), ("entertainment", "museum"), ("dining", "fast_food"),
                   (None, None), (None, None)]
