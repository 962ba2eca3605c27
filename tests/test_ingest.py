"""Ingestion on small hand-written files: wide CSV, API JSON pages, lookups, staging of dirty rows."""

import datetime as dt
import json
import math

from pyspark.sql import functions as F

from areascope.plans.staging import stage_home_values, stage_schools
from areascope.sources import ingest as ING


def test_wide_csv_to_long(spark, tmp_path):
    path = tmp_path / "values_wide.csv"
    path.write_text(
        "RegionID,SizeRank,RegionName,RegionType,StateName,State,City,Metro,CountyName,2024-01-31,2024-02-29,2024-03-31\n"
        "1,0,601,zip,PR,PR,Adjuntas,,Adjuntas,100.5,,101.25\n"
        "2,1,10001,zip,NY,NY,New York,New York,New York County,500,510,0\n"
    )
    wide = ING.read_wide_csv(spark, str(path))
    long = ING.wide_to_long(wide, "home_value")
    rows = sorted((r.zip_code, r.date, r.home_value) for r in long.collect())
    assert rows == [("00601", dt.date(2024, 1, 31), 100.5), ("00601", dt.date(2024, 3, 31), 101.25),
                    ("10001", dt.date(2024, 1, 31), 500.0), ("10001", dt.date(2024, 2, 29), 510.0),
                    ("10001", dt.date(2024, 3, 31), 0.0)]
    assert "region_id" in long.columns and "county" in long.columns
    staged = stage_home_values(long)   # zero value dropped, types fixed
    assert staged.count() == 4
    assert dict(staged.dtypes)["region_id"] == "int" and dict(staged.dtypes)["date"] == "date"


def test_amenity_json_flatten(spark, tmp_path):
    doc = {"city": "Springfield", "state_name": "Illinois", "elements": [
        {"lat": 1.5, "lon": 2.5, "tags": {"leisure": "park", "name": "Central"}},
        {"center": {"lat": 3.0, "lon": 4.0}, "tags": {"shop": "mall"}},
        {"lat": 0.0, "lon": 0.0, "tags": {"amenity": "cafe", "name": "Joe"}},
        {"lat": 9.0, "lon": 9.0, "tags": {"amenity": "bank"}},
    ]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    out = ING.flatten_amenity_json(ING.read_amenity_responses(spark, str(tmp_path / "a.json")))
    rows = sorted(tuple(r) for r in out.collect())
    assert rows == [("Central", "park", "parks", 1.5, 2.5, "Springfield", "Illinois"),
                    ("Joe", "cafe", "dining", 0.0, 0.0, "Springfield", "Illinois"),
                    ("unnamed", "mall", "shopping", 3.0, 4.0, "Springfield", "Illinois")]


def test_school_pages_flatten_stage_and_fips(spark, tmp_path):
    page = {"state": "VT", "year": 2022, "next": None, "results": [
        {"ncessch": "1", "school_name": "A", "zip_mailing": "5401-1234", "zip_location": "05402", "school_level": "1",
         "school_type": 1, "enrollment": 100, "teachers_fte": 8, "free_or_reduced_price_lunch": 25},
        {"ncessch": "2", "school_name": "B", "zip_location": "05403", "school_level": "", "school_type": 1,
         "enrollment": 50, "teachers_fte": 0},
        {"ncessch": "3", "school_name": "C", "zip_mailing": "05404", "school_level": "4", "school_type": 2,
         "enrollment": 10, "teachers_fte": 1},
        {"ncessch": "4", "school_name": "D", "zip_mailing": "05405", "school_level": "9", "school_type": 1,
         "enrollment": float("nan"), "teachers_fte": 1},
    ]}
    (tmp_path / "p.json").write_text(json.dumps(page).replace("NaN", "NaN"))
    recs = ING.flatten_school_json(ING.read_school_pages(spark, str(tmp_path / "p.json")))
    regular = ING.filter_regular_schools(recs, year=2022)
    staged = stage_schools(ING.derive_school_ratios(regular))
    rows = {r.nces_school_id: r for r in staged.collect()}
    assert set(rows) == {"1", "2"}                      # type 2 filtered; NaN enrollment dropped in staging
    assert rows["1"].zip_code == "05401" and rows["1"].student_teacher_ratio == 12.5
    assert rows["1"].free_lunch_pct == 25.0 and rows["1"].school_level_name == "Primary"
    assert rows["2"].student_teacher_ratio is None and rows["2"].school_level_name == "Unknown"
    with_codes = ING.with_fips(staged, ING.fips_table(spark))
    assert [r.fips_code for r in with_codes.collect()] == [50, 50]
    unknown = staged.withColumn("state", F.lit("XX"))
    assert ING.with_fips(unknown, ING.fips_table(spark)).count() == 0


def test_derive_ratios_null_and_zero(spark):
    df = spark.createDataFrame([(None, 4.0, 1), (10, 0.0, None), (0, 2.0, 3)],
                               "enrollment int, teachers_fte double, free_lunch int")
    out = [tuple(r) for r in ING.derive_school_ratios(df).select("student_teacher_ratio", "free_lunch_pct").collect()]
    assert out == [(0.0, None), (None, 0.0), (0.0, None)]


def test_city_zip_sets_and_map_to_zip(spark):
    panel = spark.createDataFrame([("00001", "A", "S", "State"), ("00002", "A", "S", "State"), ("00003", "B", "S", "State"),
                                   ("00001", "A", "S", "State")], "zip_code string, city string, state string, state_name string")
    sets = {r.city: (r.zip_codes, r.zip_count) for r in ING.city_zip_sets(panel).collect()}
    assert sets == {"A": (["00001", "00002"], 2), "B": (["00003"], 1)}
    am = spark.createDataFrame([("x", "t", "parks", None, None, "A", "State")],
                               "amenity_name string, amenity_type string, amenity_category string, latitude double, "
                               "longitude double, city string, state_name string")
    mapped = ING.map_to_zip(am, ING.zip_city_map(panel))
    assert sorted(r.zip_code for r in mapped.collect()) == ["00001", "00002"]   # copied to every zip of the city
    assert math.isclose(ING.profile_panel(panel.withColumn("date", F.current_date())).first().row_count, 4)
