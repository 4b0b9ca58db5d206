import math

import pytest
from pyspark.sql import functions as F

from aerolith.functions import geo, scores
from aerolith.operators import sequences


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("z", [-40.0, -8.0, -1.5, 0.0, 0.3, 2.0, 7.5, 40.0])
def test_normal_cdf(spark, z):
    assert one(spark, scores.normal_cdf(F.lit(z))) == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=1e-14)


def test_distance_and_bearing(spark):
    at = [F.lit(x) for x in (0.0, 0.0, 0.0, 90.0)]
    assert one(spark, geo.distance(*at)) == pytest.approx(geo.EARTH_KM * math.pi / 2)
    assert one(spark, geo.bearing(*at)) == pytest.approx(90)


@pytest.mark.parametrize(("lon", "out"), [(181.0, -179.0), (-180.0, -180.0), (540.0, -180.0), (10.0, 10.0)])
def test_wrapped(spark, lon, out):
    assert one(spark, geo.wrapped(F.lit(lon))) == out


def test_bins_take_their_closed_side(spark):
    labels = lambda right: [one(spark, geo.binned(F.lit(v), [0, 1, 2], ["a", "b"], right)) for v in (0.0, 1.0, 2.0, 3.0)]
    assert labels(True) == ["a", "a", "b", None]
    assert labels(False) == ["a", "b", None, None]


def test_segments_on_empty_rows(spark):
    empty = spark.createDataFrame([], "station long, ts timestamp, event_id long, value double")
    assert sequences.segments(empty, "station", "ts", "event_id", 12).count() == 0
