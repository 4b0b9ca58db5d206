"""Units, station metadata and licences on odd rows."""

import pytest
from pyspark.sql import functions as F

from aerolith.operators import protocols


@pytest.mark.parametrize("kind,rows,want", [
    ("pressure", [("a", "Pa", 500.0), ("b", " hPa", 500.0), ("c", None, 90000.0), ("c", None, 500.0), ("c", None, 80000.0), ("d", None, None)], {"a": [5.0], "b": [500.0], "c": [5.0, 800.0, 900.0], "d": [None]}),
    ("temperature", [("a", "degree_celsius", 150.0), ("b", "K", 250.0), ("c", "", -40.0), ("c", "", 20.0), ("d", "C", None)], {"a": [423.15], "b": [250.0], "c": [233.15, 293.15], "d": [None]}),
    ("humidity", [("a", "g/kg", 0.1), ("b", "kg / kg", 0.01), ("c", None, 9.0), ("c", None, 0.001)], {"a": [0.0001], "b": [0.01], "c": [0.000001, 0.009]}),
    ("height", [("a", "km", 900.0), ("b", "m", 900.0), ("c", None, -3.0), ("c", None, 12.0)], {"a": [900000.0], "b": [900.0], "c": [-3000.0, 12000.0]}),
])
def test_units_by_text_and_by_values(spark, kind, rows, want):
    df = spark.createDataFrame(rows, "id string, unit string, v double")
    got = {}
    for r in df.select("id", protocols.converted(F.col("v"), F.col("unit"), kind, ["id"]).alias("v")).collect():
        got.setdefault(r.id, []).append(r.v)
    assert {k: sorted(v, key=lambda x: (x is None, x)) for k, v in got.items()} == {k: [x if x is None else pytest.approx(x) for x in v] for k, v in want.items()}
    with pytest.raises(ValueError, match="unknown kind"):
        protocols.converted(F.col("v"), F.col("unit"), "wind", ["id"])


def test_stations_kept_excluded_and_with_issues(spark):
    rows = [(1, 45.0, 10.0, 100.0), (2, 91.0, 200.0, 100.0), (3, None, 0.0, float("nan")), (4, -90.0, 180.0, 9001.0), (5, float("nan"), 5.0, None)]
    kept, excluded, issues = protocols.stations_by_use(spark.createDataFrame(rows, "station_no long, latitude double, longitude double, elevation_m double"))
    assert sorted((r.station_no, r.elevation_m) for r in kept.collect()) == [(1, 100.0), (4, None)]
    assert {r.station_no: r.exclusion_reason for r in excluded.collect()} == {2: "invalid_latitude;invalid_longitude", 3: "invalid_latitude", 5: "invalid_latitude"}
    assert sorted(r.station_no for r in issues.collect()) == [3, 4, 5]


def test_licences_in_and_out_of_a_block(spark):
    split = spark.createDataFrame([(1, "train"), (2, "train"), (3, "calibration")], "station_no long, role string")
    rows = spark.createDataFrame([(s, f"2020-01-{t:02d}", a, o) for s, a, o in ((1, 10.0, 70.0), (2, 10.0, 200.0), (3, 10.0, 70.0)) for t in (1, 2, 3)], "station_no long, day string, latitude double, longitude double").withColumn("time", F.col("day").cast("timestamp"))
    matrix = [("p", "fit", "train", "2020-01-01", "2020-01-02"), ("b", "score", "block_in", "2020-01-02", "2020-01-04"), ("b", "fit", "block_out", "2020-01-01", "2020-01-04"), ("b", "calibrate", "block_out_calibration", "2020-01-01", "2020-01-04")]
    found = protocols.licensed(rows, split, matrix, "lat3_lon1")
    got = sorted((r.protocol, r.phase, r.station_no, r.day[-1]) for r in found.collect())
    assert got == [("b", "fit", 2, "1"), ("b", "fit", 2, "2"), ("b", "fit", 2, "3"), *[("b", "score", s, d) for s in (1, 3) for d in "23"], ("p", "fit", 1, "1"), ("p", "fit", 2, "1")]
    assert protocols.unused(found, matrix) == [("b", "calibrate")]
    with pytest.raises(ValueError, match="needs a block"):
        protocols.licensed(rows, split, matrix)
