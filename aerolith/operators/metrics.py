"""Aggregates over errors: point metrics, budgets, decompositions, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.functions import scores


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def point(error: Column) -> list[Column]:
    e = finite(error)
    return [F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias")]


def grouped(df: DataFrame, error: str, groupings: dict[str, str]) -> DataFrame:
    """grouping, group, n, rmse, mae, bias: one pass over the rows for all groupings (name: column) and "overall"."""
    names = list(groupings)
    rows = df.select(F.col(error).alias("e"), *(F.col(c).cast("string").alias(k) for k, c in groupings.items()))
    sets = [[F.col(k)] for k in names] + [[]]
    out = rows.groupingSets(sets, *(F.col(k) for k in names)).agg(F.grouping_id().alias("id"), *point(F.col("e")))
    n = len(names)
    grouping, group = F.lit("overall"), F.lit("all")
    for i, k in enumerate(names):
        mine = F.col("id") == ((1 << n) - 1) ^ (1 << (n - 1 - i))
        grouping, group = F.when(mine, k).otherwise(grouping), F.when(mine, F.col(k)).otherwise(group)
    return out.select(grouping.alias("grouping"), group.alias("group"), "n", "rmse", "mae", "bias")


def budget(dry: Column, wet: Column) -> list[Column]:
    """Mean square of a sum of two errors, split into their own mean squares and the cross term."""
    total = dry + wet
    return [
        F.avg(dry * dry).alias("mse_dry"), F.avg(wet * wet).alias("mse_wet"), (2 * F.avg(dry * wet)).alias("cross"), F.avg(total * total).alias("mse_total"),
        F.pow(F.avg(total), F.lit(2)).alias("bias2"), F.var_pop(total).alias("variance"), (2 * F.covar_pop(dry, wet)).alias("covariance2"), (2 * F.avg(dry) * F.avg(wet)).alias("bias_product2"),
    ]


def correction(residual: Column, change: Column) -> list[Column]:
    """What a correction does to the mean square: penalty mean(c * c) less alignment 2 * mean(r * c)."""
    error, base = change - residual, -residual
    return [
        F.avg(change * change).alias("penalty"), (2 * F.avg(residual * change)).alias("alignment"), (F.avg(error * error) - F.avg(base * base)).alias("delta_mse"),
        (F.pow(F.avg(error), F.lit(2)) - F.pow(F.avg(base), F.lit(2))).alias("delta_bias2"), (F.var_pop(error) - F.var_pop(base)).alias("delta_variance"),
    ]


def gaussian(error: Column, sd: Column) -> list[Column]:
    width, score = scores.interval_score(error, sd, 0.9)
    inside = [F.avg((F.abs(error) <= sd * z).cast("double")).alias(f"coverage_{int(level * 100)}") for level, z in scores.QUANTILES.items()]
    return [F.avg(scores.nll(error, sd)).alias("nll"), F.avg(scores.crps(error, sd)).alias("crps"), F.avg(score).alias("interval_score_90"), F.avg(width).alias("width_90"), *inside]


def calibration(df: DataFrame, z: Column, bins: int = 20) -> DataFrame:
    """bin, n: histogram of the probability integral transform; every bin is present, the last one closed."""
    hits = df.select(F.least(F.floor(scores.normal_cdf(z) * bins), F.lit(bins - 1)).alias("bin")).groupBy("bin").count()
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(hits, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("n"))
