"""Moist-air and refractivity formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the formulas.
RATIO, DRY, WET, GRAVITY, RADIUS = 0.622, 77.6, 3.73e5, 9.80665, 6_371_000.0


def saturation_pressure(t_c: Column) -> Column:
    """hPa over water, from degrees Celsius."""
    return 6.112 * F.exp(17.67 * t_c / (t_c + 243.5))


def vapor_pressure(t_c: Column, depression: Column, humidity: Column) -> tuple[Column, Column]:
    """(hPa, source): from the dewpoint depression if it isn't negative, else from a relative humidity of 0 to 110."""
    by_dew, by_humidity = depression >= 0, humidity.between(0, 110)
    value = F.when(by_dew, saturation_pressure(t_c - depression)).when(by_humidity, humidity / 100 * saturation_pressure(t_c))
    return value, F.when(by_dew, "dewpoint_depression").when(by_humidity, "relative_humidity").otherwise("missing")


def specific_humidity(e: Column, p: Column) -> Column:
    below = p - 0.378 * e
    return F.when((below > 0) & (e >= 0), RATIO * e / below)


def refractivity(t: Column, q: Column, p: Column) -> tuple[Column, Column, Column]:
    """(dry, wet, total)"""
    e = q * p / (RATIO + 0.378 * q)
    dry, wet = DRY * p / t, WET * e / (t * t)
    return dry, wet, dry + wet


def geopotential_height(z: Column) -> Column:
    return z / GRAVITY


def geometric_height(h: Column) -> Column:
    """Null from the Earth's radius on."""
    return F.when(h < RADIUS, RADIUS * h / (RADIUS - h))


def standard_height(p: Column) -> Column:
    return 44330 * (1 - F.pow(p / 1013.25, F.lit(0.1903)))


def modified_refractivity(n: Column, h: Column) -> Column:
    return n + 0.157 * h


def attribution(t_o: Column, q_o: Column, t_b: Column, q_b: Column, p: Column) -> tuple[Column, Column]:
    """The shares of temperature and humidity in N(t_o, q_o) - N(t_b, q_b), each averaged over both orders of exchange."""
    n = lambda t, q: refractivity(t, q, p)[2]
    by_t = ((n(t_o, q_b) - n(t_b, q_b)) + (n(t_o, q_o) - n(t_b, q_o))) / 2
    by_q = ((n(t_b, q_o) - n(t_b, q_b)) + (n(t_o, q_o) - n(t_o, q_b))) / 2
    return by_t, by_q


def apportioned(total: Column, wet_fraction: Column) -> tuple[Column, Column]:
    """(dry, wet) of a total."""
    wet = total * F.greatest(F.lit(0.0), F.least(F.lit(1.0), wet_fraction))
    return total - wet, wet
