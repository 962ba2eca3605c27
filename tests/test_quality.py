"""Data-quality checks count violations the way the declared tests do (nulls pass unique/accepted)."""

from areascope.operators import quality as Q


def test_run_checks(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z"), ("b", None), ("c", "x")], "k string, v string")
    out = {(r.column_name, r.test): r.violations for r in Q.run_checks("m", df, [
        Q.not_null("k"), Q.unique("k"), Q.accepted_values("v", ["x", "y"]), Q.not_null("v")]).collect()}
    assert out == {("k", "not_null"): 1, ("k", "unique"): 1, ("v", "accepted_values"): 1, ("v", "not_null"): 1}


def test_unique_on_pair(spark):
    df = spark.createDataFrame([("z", 1), ("z", 1), ("z", 2)], "zip string, m int")
    assert Q.unique_violations(df, ["zip", "m"]).count() == 1
