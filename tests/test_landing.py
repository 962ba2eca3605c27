"""Landed files as they come: releases, rewritten months, broken pages, chains of pages."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from areascope.sources import ingest as ING
from areascope.sources import pages as PG
from areascope.sources import releases as RL

META = "RegionID,SizeRank,RegionName,RegionType,StateName,State,City,Metro,CountyName"


def day(m):
    return dt.date(2024, m, 1)


def release(path, months, rows, meta=META, bom=""):
    path.write_text(bom + ",".join([meta, *[f"2024-{m:02d}-01" for m in months]]) + "\n" + "".join(
        f'{i},0,{600 + i},zip,NY,NY,"New, York",M,C,{",".join("" if v is None else str(v) for v in vs)}\n' for i, vs in rows))


def test_releases_with_other_months(spark, tmp_path):
    """Values stay in their months though both files are read together, and the newest release wins."""
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    release(a, [1, 2], [(1, [10, 20]), (2, [11, None])])
    release(b, [2, 3], [(1, [21, 30]), (2, [None, 31])], bom="﻿")
    long = RL.read_wide_releases(spark, [str(a), str(b)], "home_value")
    assert sorted((r.region_id, r.date.month, r.home_value, r.release.last_month) for r in long.collect()) == [
        ("1", 1, 10.0, "2024-02-01"), ("1", 2, 20.0, "2024-02-01"), ("1", 2, 21.0, "2024-03-01"), ("1", 3, 30.0, "2024-03-01"),
        ("2", 1, 11.0, "2024-02-01"), ("2", 3, 31.0, "2024-03-01")]
    one = RL.newest_wins(long)
    assert {(r.region_id, r.date, r.home_value) for r in one.collect()} == {
        ("1", day(1), 10.0), ("1", day(2), 21.0), ("1", day(3), 30.0), ("2", day(1), 11.0), ("2", day(3), 31.0)}
    assert {(r.zip_code, r.city) for r in one.collect()} == {("00601", "New, York"), ("00602", "New, York")}
    with pytest.raises(Exception, match="(?i)header"):       # one header for both would shift values
        ING.wide_to_long(ING.read_wide_csv(spark, [str(a), str(b)]), "home_value").collect()


def test_releases_of_other_shapes(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.csv").write_text("RegionID,2024-05-01,City\n7,1.5,X\n8\n")        # other order, missing columns, short line
    (tmp_path / "c" / "2.csv").write_text("RegionID,City,2024-04-01,2024-05-01\n7,Y,2,3\n")
    long = RL.read_wide_releases(spark, str(tmp_path / "c"), "v")
    assert sorted((r.region_id, r.city, r.date, r.v) for r in long.collect()) == [("7", "X", day(5), 1.5), ("7", "Y", day(4), 2.0), ("7", "Y", day(5), 3.0)]
    assert {r.zip_code for r in long.collect()} == {None}
    (tmp_path / "c" / "3.csv").write_text("1,2,3\n")
    with pytest.raises(Exception, match="no header in .*3.csv"):
        RL.read_wide_releases(spark, str(tmp_path / "c"), "v").collect()
    (tmp_path / "d.csv").write_text("1,2,3\n")
    with pytest.raises(ValueError, match="no file has a header"):
        RL.read_wide_releases(spark, str(tmp_path / "d.csv"), "v")


def files(table):
    found = {}
    for f in table.select(F.col("_metadata.file_path")).distinct().collect():
        path = f[0].removeprefix("file://").replace("file:", "")
        found[path] = os.stat(path).st_mtime_ns
    return found


def test_rewriting_a_month_leaves_the_others(spark):
    df = spark.createDataFrame([(i, m, float(i)) for m in (1, 2, 3) for i in range(50)], "id int, month int, v double")
    table = RL.write_raw_table(df, "areascope_raw.rewritten", ("month",))
    before = files(table)
    change = df.where("month = 3 AND id < 20").withColumn("v", F.lit(-1.0)).select("month", "v", "id")     # columns in any order
    new = change.unionByName(spark.createDataFrame([(1, 4, 9.0)], "id int, month int, v double"))
    table = RL.write_raw_table(new, "areascope_raw.rewritten", ("month",), rewrite=True)
    after = files(table)
    assert {f: t for f, t in before.items() if "month=3" not in f} == {f: t for f, t in after.items() if "month=1" in f or "month=2" in f}
    assert {(r.month, r.n, r.s) for r in table.groupBy("month").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()} == {
        (1, 50, 1225.0), (2, 50, 1225.0), (3, 20, -20.0), (4, 1, 9.0)}
    RL.write_raw_table(change.limit(0), "areascope_raw.rewritten", ("month",), rewrite=True)                # nothing to rewrite
    assert spark.table("areascope_raw.rewritten").count() == 121
    RL.write_raw_table(df.limit(5), "areascope_raw.rewritten", ("month",))                                  # a full write replaces all
    assert spark.table("areascope_raw.rewritten").count() == 5


GOOD = {"city": "C", "state_name": "S", "elements": [{"lat": 1.0, "lon": 2.0, "tags": {"leisure": "park"}}]}


def test_bad_pages_go_to_quarantine(spark, tmp_path):
    lines = [json.dumps(GOOD), json.dumps(GOOD)[:40], '{"remark": "rate limited"}', "", "<html>502</html>", '{"city": 5, "state_name": "S", "elements": "x"}',
             json.dumps({**GOOD, "elements": []}), "null", "  "]
    (tmp_path / "p.jsonl").write_text("\n".join(lines))
    pages = PG.sort_pages(spark, str(tmp_path / "p.jsonl"), ING.AMENITY_RESPONSE_SCHEMA, ["city", "state_name", "elements"])
    assert pages.good.count() == 2 and ING.flatten_amenity_json(pages.good).count() == 1
    got = {(r.reason, r.page) for r in pages.quarantine.collect()}
    assert {p for _, p in got} == {lines[1], lines[2], lines[4], lines[5], "null"} and (PG.CORRUPT, lines[1]) in got and (PG.INCOMPLETE, lines[2]) in got
    assert (PG.CORRUPT, lines[4]) in got and (PG.CORRUPT, lines[5]) in got
    assert pages.all.count() == 7 and all(r.file.endswith("p.jsonl") for r in pages.quarantine.collect())


def test_whole_file_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(GOOD, indent=2))
    (tmp_path / "b.json").write_text(json.dumps(GOOD, indent=2)[:-3])
    pages = PG.sort_pages(spark, str(tmp_path), ING.AMENITY_RESPONSE_SCHEMA, ["city"], multi_line=True)
    assert pages.good.count() == 1 and [(r.reason, r.file.rsplit("/", 1)[-1]) for r in pages.quarantine.collect()] == [(PG.CORRUPT, "b.json")]


def test_chains(spark):
    chain = lambda r, ks, n: [(f"{r}/{k}", f"{r}/{k + 1}" if k < n else None) for k in ks]
    rows = [*chain("a", range(1, 101), 100), *chain("b", [k for k in range(1, 60) if k not in (17, 40)], 59), *chain("c", [2, 3], 3), *chain("e", [1], 1),
            ("f/1", "f/2"), ("f/2", "f/3"), ("f/3", "f/2"), ("e/1", None), ("a/5", "a/6"), (None, "a/1"), ("g/1", "g/1")]
    requests = spark.createDataFrame([(r, f"{r}/1") for r in "abcdefg"], "request string, first_url string")
    got = {r.request: (r.pages_reached, r.complete, r.missing) for r in PG.follow_chains(requests, spark.createDataFrame(rows, "url string, next string")).collect()}
    assert got == {"a": (100, True, None), "b": (16, False, "b/17"), "c": (0, False, "c/1"), "d": (0, False, "d/1"), "e": (1, True, None),
                   "f": (None, False, None), "g": (None, False, None)}
