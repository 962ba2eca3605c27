"""Pages that land again under another name."""

import json

import pytest

from areascope.streaming import amenity_page_stream, append_to_table


def page(name):
    return {"city": "C", "state_name": "S", "elements": [{"lat": 1.0, "lon": 2.0, "tags": {"leisure": "park", "name": name}}]}


@pytest.mark.parametrize("within", [None, "30 days"])
def test_a_page_that_lands_again_changes_nothing(spark, tmp_path, within):
    land, table, ckpt = tmp_path / "land", tmp_path / "table", tmp_path / "ckpt"
    land.mkdir()

    def run():
        append_to_table(amenity_page_stream(spark, str(land), once=True, within=within), str(table), str(ckpt)).awaitTermination()
        return sorted(r.amenity_name for r in spark.read.parquet(str(table)).collect())

    (land / "p1.json").write_text(json.dumps(page("a")))
    (land / "p2.json").write_text(json.dumps(page("a")))              # the same page twice at once
    assert run() == ["a"]
    (land / "again.json").write_text(json.dumps(page("a"), indent=1))  # and later, written in another way
    (land / "p3.json").write_text(json.dumps(page("b")))
    assert run() == ["a", "b"]
    (land / "p1-copy.json").write_text(json.dumps(page("a")))
    (land / "p3-copy.json").write_text(json.dumps(page("b")))
    assert run() == ["a", "b"]                                         # by a restarted query
