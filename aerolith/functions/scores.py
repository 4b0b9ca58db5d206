"""Scores of a normal predictive distribution as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of a public rational form of the normal tail, highest power first.
UPPER = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
LOWER = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
#: Two-sided normal quantiles.
QUANTILES = {0.5: 0.674489750196082, 0.68: 0.994457883209753, 0.8: 1.2815515655446, 0.9: 1.64485362695147, 0.95: 1.95996398454005}


def _horner(a: Column, coefficients: tuple) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * a + c
    return out


def normal_cdf(z: Column) -> Column:
    a = F.abs(z)
    e = F.exp(-a * a / 2)
    far = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, e * _horner(a, UPPER) / _horner(a, LOWER)).otherwise(e / (far * 2.506628274631))
    return F.when(z > 0, 1 - tail).otherwise(tail)


def normal_cdf_sql(z: str) -> str:
    def poly(cs: tuple) -> str:
        out = repr(cs[0])
        for c in cs[1:]:
            out = f"({out} * abs({z}) + CAST({c!r} AS DOUBLE))"
        return out.replace(repr(cs[0]), f"CAST({cs[0]!r} AS DOUBLE)", 1)

    a, e = f"abs({z})", f"exp(-({z}) * ({z}) / 2)"
    far = f"({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + CAST(0.65 AS DOUBLE))))))"
    tail = f"(CASE WHEN {a} > 37 THEN 0 WHEN {a} < 7.07106781186547 THEN {e} * {poly(UPPER)} / {poly(LOWER)} ELSE {e} / ({far} * 2.506628274631) END)"
    return f"(CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


def nll(error: Column, sd: Column) -> Column:
    z = error / sd
    return z * z / 2 + F.log(sd) + math.log(2 * math.pi) / 2


def crps(error: Column, sd: Column) -> Column:
    z = error / sd
    return sd * (z * (2 * normal_cdf(z) - 1) + 2 * F.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi))


def crps_sql(error: str, sd: str) -> str:
    z = f"({error} / {sd})"
    return f"({sd} * ({z} * (2 * {normal_cdf_sql(z)} - 1) + 2 * exp(-{z} * {z} / 2) / {math.sqrt(2 * math.pi)!r} - 1 / {math.sqrt(math.pi)!r}))"


def interval_score(error: Column, sd: Column, level: float) -> tuple[Column, Column]:
    """(width, score) of the central interval: the score adds 2 / alpha times the distance outside."""
    half = sd * QUANTILES[level]
    return 2 * half, 2 * half + 2 / (1 - level) * F.greatest(F.abs(error) - half, F.lit(0.0))
