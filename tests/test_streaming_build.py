"""Streaming ingestion of landed pages, raw writes, schema creation and the layered build."""

import json

from areascope.plans.build import build, load_mart
from areascope.registry import layers
from areascope.sources import ingest as ING
from areascope.streaming import amenity_page_stream, append_to_table, school_page_stream


def test_amenity_pages_stream_exactly_once(spark, tmp_path):
    land, table, ckpt = tmp_path / "land", tmp_path / "table", tmp_path / "ckpt"
    land.mkdir()
    page = {"city": "C", "state_name": "S", "elements": [{"lat": 1.0, "lon": 2.0, "tags": {"leisure": "park"}},
                                                         {"lat": 1.0, "lon": 2.0, "tags": {"amenity": "bank"}}]}
    (land / "p1.json").write_text(json.dumps(page))
    append_to_table(amenity_page_stream(spark, str(land)), str(table), str(ckpt)).awaitTermination()
    assert spark.read.parquet(str(table)).count() == 1
    (land / "p2.json").write_text(json.dumps(page))
    append_to_table(amenity_page_stream(spark, str(land)), str(table), str(ckpt)).awaitTermination()
    assert spark.read.parquet(str(table)).count() == 2        # only the new page was processed


def test_school_pages_stream(spark, tmp_path):
    land, table, ckpt = tmp_path / "land", tmp_path / "table", tmp_path / "ckpt"
    land.mkdir()
    page = {"state": "VT", "year": 2017, "results": [
        {"ncessch": "1", "zip_mailing": "5401", "school_type": 1, "enrollment": 30, "teachers_fte": 4},
        {"ncessch": "2", "zip_mailing": "5402", "school_type": 3, "enrollment": 30, "teachers_fte": 4}]}
    (land / "p.json").write_text(json.dumps(page))
    append_to_table(school_page_stream(spark, str(land)), str(table), str(ckpt), partition_by=("year",)).awaitTermination()
    rows = spark.read.parquet(str(table)).collect()
    assert [(r.nces_school_id, r.zip_code, r.student_teacher_ratio, r.year) for r in rows] == [("1", "05401", 7.5, 2017)]


def test_write_raw_and_schema(spark, tmp_path):
    df = spark.createDataFrame([(1, 2017), (2, 2022)], "id int, year int")
    assert ING.write_raw(df, str(tmp_path / "raw"), partition_by=("year",))
    assert spark.read.parquet(str(tmp_path / "raw")).where("year = 2022").count() == 1
    assert not ING.write_raw(df.where("id > 5"), str(tmp_path / "empty"), skip_empty=True)
    ING.ensure_schema(spark, "areascope_raw")
    assert "areascope_raw" in [d.name for d in spark.catalog.listDatabases()]
    both = ING.union_years(df.where("year = 2017"), df.where("year = 2022"))
    assert both.count() == 2


def test_layered_build(spark):
    p = layers(spark, "/root/testdata/sf0.001")
    marts = build(p, "areascope_marts")
    assert set(marts) == {"market_intelligence", "investment_hotspots", "area_comparison"}
    stored = load_mart(spark, "areascope_marts", "market_intelligence")
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, p.market_intelligence.collect()))
    assert spark.sql("SELECT count(*) FROM int_price_trends").first()[0] == stored.count()
    raw = spark.table("areascope_marts.raw_schools")
    assert raw.where("year = 2022").count() == p.raw_schools.where("year = 2022").count() > 0
