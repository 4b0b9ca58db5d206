"""Streaming jobs on level and series reports; each takes a streaming or a batch DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(df: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """station, first_time, n, value: runs of reports with gaps below gap."""
    return df.withWatermark("ts", late).groupBy("station", F.session_window("ts", gap)).agg(F.min("ts").alias("first_time"), F.count("*").alias("n"), F.avg("value").alias("value"))


def once(df: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first report of each key; a repeated one within the watermark is dropped."""
    marked = df.withWatermark(time, late)
    return marked.dropDuplicatesWithinWatermark(keys) if df.isStreaming else marked.dropDuplicates(keys)


def counters(df: DataFrame, time: str, reason: str, late: str = "1 day") -> DataFrame:
    """Reports by day and reason."""
    return df.withWatermark(time, late).groupBy(F.window(time, "1 day").start.alias("day"), reason).agg(F.count("*").alias("n"))


def rolling(df: DataFrame, late: str = "1 day") -> DataFrame:
    """Mean of the last seven days by station, each day."""
    days = df.withWatermark("ts", late).groupBy("station", F.window("ts", "7 days", "1 day")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return days.select("station", F.col("window.end").alias("until"), "value", "n")


def incremental(stream: DataFrame, job: Callable[[DataFrame], DataFrame], out: str, state: str) -> None:
    """Runs job on the files that have come since the last run and stops; files done before are not read again.

    A batch that is repeated after a failure writes over its own folder. state: the folder that remembers what is done.
    """

    def put(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
