"""What a stream of pages keeps of each page."""

import json

from pyspark.sql import functions as F

from areascope.sources import ingest as ING
from areascope.streaming import amenity_page_stream, append_to_table
from areascope.streaming.ingest import distinct_pages


def test_a_page_is_known_by_its_whole_content_though_a_part_goes_on(spark):
    pages = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "city string, n int").withColumn("landed", F.current_timestamp())
    once = distinct_pages(pages, keep={"town": F.upper("city")})
    assert [tuple(r) for r in once.collect()] == [("A",), ("A",)] and once.columns == ["town"]


def test_streamed_amenities_are_those_of_the_batch(spark, tmp_path):
    elements = [{"lat": 1.0, "lon": 2.0, "tags": {"leisure": "park", "name": "p"}}, {"center": {"lat": 3.0, "lon": 4.0}, "tags": {"shop": "bakery"}},
                {"tags": {"tourism": "hotel"}}, {"lat": 5.0}, {"tags": {}}, None]
    lines = [{"city": "C", "state_name": "S", "elements": elements}, {"city": "D", "state_name": None, "elements": None}, {"city": None, "elements": elements[:1]},
             {"city": "E", "state_name": "S", "elements": elements[2:]}]
    (tmp_path / "land").mkdir()
    (tmp_path / "land" / "p.json").write_text("\n".join(json.dumps(x) for x in [*lines, *lines]))
    stream = amenity_page_stream(spark, str(tmp_path / "land"), multi_line=False, once=True)
    append_to_table(stream, str(tmp_path / "table"), str(tmp_path / "ckpt")).awaitTermination()
    (tmp_path / "batch").mkdir()
    (tmp_path / "batch" / "p.json").write_text("\n".join(json.dumps(x) for x in lines))
    batch = ING.flatten_amenity_json(ING.read_amenity_responses(spark, str(tmp_path / "batch"), multi_line=False))
    got = spark.read.parquet(str(tmp_path / "table"))
    assert stream.columns == batch.columns and got.count() == 3
    assert sorted(map(str, got.select(*batch.columns).collect())) == sorted(map(str, batch.collect()))
