"""Distances, bearings, regions and calendar bins as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance by the haversine formula; degrees in, the radius' unit out."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360, F.lit(360.0))


def wrapped(lon: Column) -> Column:
    """-180 to 180, the upper end open."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def region(lat: Column) -> Column:
    return F.when(lat >= 30, "north").when(lat <= -30, "south").otherwise("tropics")


def latitude_band(lat: Column) -> Column:
    a = F.abs(lat)
    return F.when(a < 23.5, "tropics").when(a < 35, "subtropics").when(a < 60, "midlatitudes").otherwise("polar")


def season(time: Column) -> Column:
    return F.element_at(F.array(*(F.lit(s) for s in ("DJF", "MAM", "JJA", "SON"))), (F.month(time) % 12 / 3).cast("int") + 1)


def block(lat: Column, lon: Column) -> Column:
    """30 by 60 degree blocks."""
    i, j = F.floor((lat + 90) / 30), F.floor(F.pmod(lon, F.lit(360.0)) / 60)
    return F.concat(F.lit("lat"), F.least(F.greatest(i, F.lit(0)), F.lit(5)).cast("string"), F.lit("_lon"), F.least(F.greatest(j, F.lit(0)), F.lit(5)).cast("string"))


def binned(value: Column, edges: list[float], labels: list[str], right_closed: bool = True) -> Column:
    """Label of the bin between edges; right-closed bins take their lowest edge too, left-closed ones their highest not."""
    out = F.lit(None).cast("string")
    for k in range(len(labels) - 1, -1, -1):
        low, high = edges[k], edges[k + 1]
        inside = ((value > low) | ((value == low) if k == 0 else F.lit(False))) & (value <= high) if right_closed else (value >= low) & (value < high)
        out = F.when(inside, labels[k]).otherwise(out)
    return out
