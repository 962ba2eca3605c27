"""What relanded pages cost: the memory of the keys, and the documents built as texts."""

import json
import re

import pytest
from pyspark.sql import functions as F

from areascope.sources import ingest as ING
from areascope.sources import landed as LD
from areascope.streaming import amenity_page_stream, append_to_table
from areascope.streaming.ingest import RETAINED


@pytest.mark.parametrize("own", [None, "1"])
def test_a_run_does_not_keep_the_keys_of_all_pages_in_memory(spark, tmp_path, own):
    land = tmp_path / "land"
    pages = spark.range(4000).select(F.concat(F.lit('{"city":"C","state_name":"S","elements":[{"tags":{"leisure":"park","name":"'), "id", F.lit('"}}]}')).alias("document"))
    try:
        if own:
            spark.conf.set(RETAINED, own)
        for _ in range(2):
            LD.write_pages(pages, str(land))
            run = append_to_table(amenity_page_stream(spark, str(land), multi_line=False, once=True), str(tmp_path / "table"), str(tmp_path / "ckpt"))
            run.awaitTermination()
            state = run.lastProgress["stateOperators"][0]
            assert state["numRowsTotal"] == 4000
            # the keys of 4000 pages take 800 thousand bytes and more
            assert (state["memoryUsedBytes"] > 400_000) == bool(own)
            assert spark.conf.get(RETAINED, None) == own
    finally:
        spark.conf.unset(RETAINED)
    assert spark.read.parquet(str(tmp_path / "table")).count() == 4000


def test_documents_of_odd_lines_are_the_json_of_their_elements(spark, tmp_path):
    lines = [(1, 1, 1, 1, 0.04, 0.02), (1, 2, 2, 1, 0.05, None), (1, 3, 1, 1, None, 0.01), (1, 1, 1, 1, 0.04, 0.02), (1, 1, 1, 2, 0.01, 0.01),
             (None, 1, 2, 2, 0.07, 0.0), (2, None, 1, 3, 0.02, 0.03), (3, 6, 3, 3, 0.1, 0.08), (4, 1, None, 3, 0.1, 0.1), (4, 1, 9, 3, 0.1, 0.1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double, l_tax double") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 'a "b"', "SMALL"), (2, None, "STANDARD"), (3, "c", "LARGE")], "p_partkey long, p_name string, p_type string") \
        .write.parquet(f"{tmp_path}/part.parquet")
    dim = spark.createDataFrame([(1, 'C "1"', "S"), (2, 'C "1"', "S"), (3, None, None)], "s_suppkey long, city string, state_name string")
    docs = LD.amenity_documents(spark, str(tmp_path), dim)
    got = sorted((json.dumps({**d, "elements": sorted(json.dumps(e) for e in d["elements"])}), r.page or 0) for r in docs.collect() for d in [json.loads(r.document)])

    def element(line, disc, tax, key, value, name):
        disc, tax = (v * 100 if v is not None else None for v in (disc, tax))
        at = {k: v for k, v in (("lat", disc), ("lon", tax)) if v is not None}
        tags = {key: value} | ({"name": name} if line is None or line % 3 else {})
        tags = {key: value} if line is None else tags
        return json.dumps((at if line is not None and line % 2 else {"center": at} if line is not None else {}) | {"tags": tags})

    small, standard, large = ("shop", "supermarket", 'a "b"'), ("tourism", "hotel", None), ("amenity", "restaurant", "c")
    first = {"city": 'C "1"', "state_name": "S"}
    expected = [(first, 1, [element(1, 0.04, 0.02, *small), element(2, 0.05, None, *standard), element(3, None, 0.01, *small), element(1, 0.04, 0.02, *small),
                            element(1, 0.01, 0.01, *small)]),
                (first, 0, [element(1, 0.07, 0.0, *standard)]), ({}, 2, [element(None, 0.02, 0.03, *small)]), ({}, 3, [element(6, 0.1, 0.08, *large)])]
    assert got == sorted((json.dumps({**head, "elements": sorted(es)}), page) for head, page, es in expected)
    # the text is what Spark writes of the parsed page
    again = docs.select("document", F.to_json(F.from_json("document", ING.AMENITY_RESPONSE_SCHEMA)).alias("again")).collect()
    assert all(r.document == r.again for r in again)


def test_lines_meet_as_columns_and_once(spark):
    plan = LD.amenity_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = plan[:re.search(r"Exchange hashpartitioning\(l_orderkey", plan).start()]
    assert "partial_collect_list(element" in above and "map_from_arrays" in above
