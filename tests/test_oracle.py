"""Every registered query against its DuckDB oracle on the smallest benchmark tables."""

import os

import pytest

import __spark_entry__ as entry
from areascope.verify import compare, duckdb_connection

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")

ORACLE = {k: v for k, v in entry.oracle_sql().items() if k not in entry.LLM_QUERIES}
QUERIES = {k: v for k, v in entry.queries().items() if k not in entry.LLM_QUERIES}


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    exp = con.execute(ORACLE[name]).df()
    ok, why = compare(got, exp)
    assert ok, f"{name}: {why}"


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "livability_score" in df.columns
