"""Operators on sounding levels: validity, masks, profiles as arrays, vertical differences, integrals and interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import atmosphere
from aerolith.sources.levels import LEVELS

PROFILE = "profile_no"


def valid_level(df: DataFrame, t_low: float = -120, t_high: float = 60) -> DataFrame:
    """Adds valid: a standard level with a temperature inside the range, a height, and a humidity."""
    t_c = F.col("temperature_k") - 273.15
    _, source = atmosphere.vapor_pressure(t_c, F.col("dewpoint_depression_c"), F.col("relative_humidity"))
    ok = F.col("pressure_hpa").isin(*LEVELS) & (t_c > t_low) & (t_c < t_high) & F.col("height_m").isNotNull() & (source != "missing")
    return df.withColumn("valid", F.coalesce(ok, F.lit(False)))


def best_per_level(df: DataFrame, *ties: str) -> DataFrame:
    """One row per profile and level: valid ones first, then the largest of ties."""
    by = Window.partitionBy(PROFILE, "pressure_hpa").orderBy(F.desc("valid"), *(F.desc(c) for c in ties))
    return df.withColumn("rn", F.row_number().over(by)).where("rn = 1").drop("rn")


def min_levels(df: DataFrame, n: int) -> DataFrame:
    """Rows of profiles with at least n valid levels."""
    count = F.sum(F.col("valid").cast("int")).over(Window.partitionBy(PROFILE))
    return df.withColumn("n_valid", count).where(F.col("n_valid") >= n)


def complete(df: DataFrame, wanted: tuple[int, ...]) -> DataFrame:
    """Rows of profiles in which every wanted level is valid."""
    ok = F.col("valid") & F.col("pressure_hpa").isin(*wanted)
    whole = df.groupBy(PROFILE).agg(F.count_if(ok).alias("n")).where(F.col("n") == len(wanted))
    return df.where(F.col("pressure_hpa").isin(*wanted)).join(whole.select(PROFILE), PROFILE, "left_semi")


def residuals(df: DataFrame) -> DataFrame:
    """Adds dry, wet and total refractivity of observation and background, and residuals (observation less background)."""
    for pre, t, q in (("obs", "temperature_k", "q"), ("bg", "bg_temperature_k", "bg_q")):
        for name, c in zip(("dry", "wet", "total"), atmosphere.refractivity(F.col(t), F.col(q), F.col("pressure_hpa")), strict=True):
            df = df.withColumn(f"{pre}_{name}", c)
    for name in ("dry", "wet", "total"):
        df = df.withColumn(f"residual_{name}", F.col(f"obs_{name}") - F.col(f"bg_{name}"))
    return df.withColumn("below_ground", F.col("surface_pressure_pa") < F.col("pressure_hpa") * 100)


def mask_reason() -> Column:
    return F.when(~F.col("valid"), "missing_observation_level").when(F.col("below_ground"), "below_ground").otherwise("available")


def mask_bits(df: DataFrame) -> DataFrame:
    """Bits of the valid levels of each profile; bit 0 is the first level."""
    bit = F.lit(0)
    for i, p in enumerate(LEVELS):
        bit = F.when(F.col("valid") & (F.col("pressure_hpa") == p), 1 << i).otherwise(bit)
    return df.groupBy(PROFILE).agg(F.sum(bit).cast("long").alias("mask_bits"))


def arrays(df: DataFrame, value: str) -> DataFrame:
    """value of each level as an array in level order, null where a level is missing."""
    at = [F.max(F.when(F.col("pressure_hpa") == p, F.col(value))) for p in LEVELS]
    return df.groupBy(PROFILE).agg(F.array(*at).alias(value))


def dense(df: DataFrame) -> DataFrame:
    """Every level of every profile; valid is false and values are null where a level is missing."""
    levels = df.sparkSession.range(1).select(F.explode(F.array(*(F.lit(p) for p in LEVELS))).alias("pressure_hpa"))
    whole = df.select(PROFILE).distinct().crossJoin(F.broadcast(levels))
    return whole.join(df, [PROFILE, "pressure_hpa"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def steps(df: DataFrame, value: str, coordinate: str) -> DataFrame:
    """x_lo, y_lo, x_hi, y_hi of neighbouring valid levels along a rising coordinate."""
    by = Window.partitionBy(PROFILE).orderBy(coordinate, F.desc("pressure_hpa"))
    out = df.where("valid").select(PROFILE, "pressure_hpa", F.col(coordinate).alias("x_lo"), F.col(value).alias("y_lo"), F.lead(coordinate).over(by).alias("x_hi"), F.lead(value).over(by).alias("y_hi"), F.lead("pressure_hpa").over(by).alias("p_hi"))
    return out.where("x_hi IS NOT NULL")


def gradients(df: DataFrame, value: str) -> DataFrame:
    """Change per km between adjacent configured levels that are both valid, with a rising height."""
    index = lambda c: F.array_position(F.array(*(F.lit(p) for p in LEVELS)), F.col(c))
    by = Window.partitionBy(PROFILE).orderBy(F.desc("pressure_hpa"))
    rows = df.where("valid").select(PROFILE, "pressure_hpa", F.lead("pressure_hpa").over(by).alias("above"), ((F.lead("height_m").over(by) - F.col("height_m")) / 1000).alias("dz"), (F.lead(value).over(by) - F.col(value)).alias("dv"))
    pair = F.concat_ws("-", F.col("pressure_hpa").cast("string"), F.col("above").cast("string"))
    return rows.where((index("above") - index("pressure_hpa") == 1) & (F.col("dz") > 0)).select(PROFILE, pair.alias("pair"), (F.col("dv") / F.col("dz")).alias("gradient"))


def integral(df: DataFrame, value: str, least: int = 3) -> DataFrame:
    """Trapezoid integral of value over -ln p of the valid levels of each profile with at least so many."""
    x = df.withColumn("x", -F.log("pressure_hpa"))
    parts = steps(x, value, "x").groupBy(PROFILE).agg(F.count("*").alias("n"), F.sum((F.col("x_hi") - F.col("x_lo")) * (F.col("y_lo") + F.col("y_hi")) / 2).alias("integral"))
    return parts.where(F.col("n") >= least - 1).select(PROFILE, (F.col("n") + 1).alias("n_levels"), "integral")


def at_heights(df: DataFrame, value: str, heights: list[int]) -> DataFrame:
    """value interpolated linearly in height to target heights, inside the profile's range only.

    Each segment lists the targets that it holds, so nothing is joined; it holds its lower end, the last one also its upper end.
    """
    segments = steps(df, value, "height_m").withColumn("top", F.max("x_hi").over(Window.partitionBy(PROFILE))).where("x_hi > x_lo")
    aims = F.array(*(F.lit(float(h)) for h in heights))
    held = F.filter(aims, lambda h: (h >= F.col("x_lo")) & ((h < F.col("x_hi")) | ((h == F.col("top")) & (F.col("x_hi") == F.col("top")))))
    f = (F.col("height") - F.col("x_lo")) / (F.col("x_hi") - F.col("x_lo"))
    return segments.withColumn("height", F.explode(held)).select(PROFILE, "height", (F.col("y_lo") + f * (F.col("y_hi") - F.col("y_lo"))).alias("value"))
