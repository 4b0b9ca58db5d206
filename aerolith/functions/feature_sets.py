"""Feature sets of the models as columns: mapping rows, calendars, coordinates, lag windows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TURN = 2 * math.pi


def around(angle: Column, name: str) -> dict[str, Column]:
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def calendar(time: Column, hour: bool = True) -> dict[str, Column]:
    """Day of the year over 366 and hour over 24, as circles."""
    days = around(F.dayofyear(time) * (TURN / 366.0), "doy")
    return days | around(F.hour(time) * (TURN / 24.0), "hour") if hour else days


def calendar_from_zero(time: Column) -> dict[str, Column]:
    """The single-site calendar: the first day of the year is angle 0."""
    return around((F.dayofyear(time) - 1) * (TURN / 366.0), "day")


def coordinates(latitude: Column, longitude: Column) -> dict[str, Column]:
    return {"lat_norm": latitude / 90.0} | around(F.radians(longitude), "lon")


def mapping(hour: bool = True, level: bool = False) -> dict[str, Column]:
    """What a background row tells of its error: refractivity, temperature, humidity, height, place, calendar; level: pressure over 1000 as well."""
    out = {"n_bg": F.col("bg_total"), "t_bg": F.col("bg_temperature_k"), "q_bg": F.col("bg_q"), "height_km": F.col("height_m") / 1000.0}
    out |= coordinates(F.col("latitude"), F.col("longitude")) | calendar(F.col("time"), hour)
    return out | ({"layer_norm": F.col("pressure_hpa") / 1000.0} if level else {})


def window(x: str, lags: int) -> dict[str, Column]:
    """The flattened window of an array column, oldest value first."""
    return {f"lag{lags - 1 - k}": F.col(x)[k] for k in range(lags)}
