"""Operators on ordered series: gap segments, supervised windows, simple forecasts, splits, unwrapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(df: DataFrame, key: str, time: str, tie: str, hours: float) -> DataFrame:
    """Adds segment: it grows by one where more than hours pass."""
    by = Window.partitionBy(key).orderBy(time, tie)
    gap = (F.unix_micros(time) - F.lag(F.unix_micros(time)).over(by)) / 3.6e9
    new = F.when(gap > hours + 1e-6, 1).otherwise(0)
    return df.withColumn("new", new).withColumn("segment", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def supervised(df: DataFrame, key: list[str], order: list[str], value: str, lags: int, horizon: int) -> DataFrame:
    """lag values as an array (oldest first) and the value horizon rows later, for each row that has all of them."""
    by = Window.partitionBy(*key).orderBy(*order)
    out = df.withColumn("x", F.collect_list(value).over(by.rowsBetween(-(lags - 1), 0))).withColumn("y", F.lead(value, horizon).over(by))
    return out.where((F.size("x") == lags) & F.col("y").isNotNull())


def forecasts(df: DataFrame, key: list[str], order: list[str], value: str, k: int, horizon: int, clip: float) -> DataFrame:
    """persistence, recent mean of k rows, and the last value moved on by a clipped trend of k rows; null where no row is that far back."""
    by = Window.partitionBy(*key).orderBy(*order)
    slope = (F.col(value) - F.lag(value, k).over(by)) / k
    out = df.withColumn("persistence", F.col(value)).withColumn("recent_mean", F.avg(value).over(by.rowsBetween(-(k - 1), 0)))
    clipped = F.when(slope.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), slope)))  # greatest and least pass over nulls
    return out.withColumn("trend", F.col(value) + horizon * clipped).withColumn("truth", F.lead(value, horizon).over(by))


def split(df: DataFrame, key: str, order: list[str], train: float, validation: float) -> DataFrame:
    """Adds part: the first, middle and last rows of each key by fractions cut to whole rows."""
    by = Window.partitionBy(key)
    i, n = F.row_number().over(by.orderBy(*order)) - 1, F.count("*").over(by)
    a, b = F.floor(n * train), F.floor(n * (train + validation))
    return df.withColumn("part", F.when(i < a, "train").when(i < b, "validation").otherwise("test"))


def unwrapped(longitude: str, key: str, order: list[str]) -> Column:
    """Longitude without jumps of over 180 degrees along the order."""
    by = Window.partitionBy(key).orderBy(*order)
    jump = F.coalesce(F.round((F.col(longitude) - F.lag(longitude).over(by)) / 360), F.lit(0.0))
    return F.col(longitude) - 360 * jump


def sums_before(df: DataFrame, column: str, key: str, order: list[str]) -> Column:
    return F.sum(column).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
