"""Splits and folds in the order of hashes, so that any engine can repeat them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split(stations: DataFrame, key: str, seed: int, train: float = 0.7, calibration: float = 0.1) -> DataFrame:
    """Adds role: stations in hash order, cut at whole numbers of stations. One row per station, so one sort of a small table."""
    by = Window.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    rows = stations.withColumn("i", F.row_number().over(by) - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * train) + F.floor(F.col("n") * calibration)
    return rows.withColumn("role", F.when(F.col("i") < a, "train").when(F.col("i") < b, "calibration").otherwise("test")).drop("i", "n")


def folds(stations: DataFrame, key: str, seed: int, k: int) -> DataFrame:
    by = Window.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    return stations.withColumn("fold", (F.row_number().over(by) - 1) % k)
