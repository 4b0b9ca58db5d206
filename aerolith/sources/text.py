"""Fixed-width text: soundings (a header line, then a line per level) and station lists, written and scanned as DataFrames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, first character and width of the fields of a level line, and what a missing value looks like.
LEVEL_FIELDS = {"pressure_pa": (10, 6), "height_m": (17, 5), "temperature_tenths": (23, 5), "humidity_tenths": (29, 5), "depression_tenths": (35, 5)}
FLAGS = {"pressure_flag": (16, 1), "temperature_flag": (28, 1)}
MISSING = (-9999, -8888)
STATION_FIELDS = {"station_no": (1, 11), "latitude": (13, 8), "longitude": (22, 9), "elevation_m": (32, 6), "name": (42, 30)}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only for a local master without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to a new folder that all executors share, and read again: what follows doesn't compute it twice, or again if an executor is lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_soundings(levels: DataFrame, path: str) -> None:
    """levels: profile_no, station_no, time, and the level fields as whole numbers, null where missing."""
    number = lambda c, width: F.lpad(F.coalesce(F.col(c).cast("long"), F.lit(MISSING[0])).cast("string"), width, " ")
    line = F.concat(
        F.lit("10 00000"), F.lit(" "), number("pressure_pa", 6), F.col("pressure_flag"), number("height_m", 5), F.lit(" "), number("temperature_tenths", 5), F.col("temperature_flag"), number("humidity_tenths", 5), F.lit(" "), number("depression_tenths", 5)
    )
    head = F.concat_ws(" ", F.concat(F.lit("#"), F.lpad(F.col("station_no").cast("string"), 11, "0")), F.date_format("time", "yyyyMMddHH"), F.col("profile_no").cast("string"))
    record = F.concat_ws("\n", head, F.array_join(F.sort_array(F.collect_list(line)), "\n"))
    levels.groupBy("profile_no", "station_no", "time").agg(record.alias("value")).select("value").write.text(path)


def _field(at: tuple[int, int], of: str = "line") -> Column:
    return F.trim(F.substring(of, *at))


def soundings(spark: SparkSession, path: str) -> DataFrame:
    """One row per level line, with its header's station, time and number. A record ends where the next header begins."""
    records = spark.read.option("lineSep", "\n#").text(path).select(F.split(F.regexp_replace("value", "^#", ""), "\n").alias("ls"))
    head = F.split(F.col("ls")[0], " +")
    lines = records.select(head[0].cast("long").alias("station_no"), F.to_timestamp(head[1], "yyyyMMddHH").alias("time"), head[2].cast("long").alias("profile_no"), F.explode(F.slice("ls", 2, 1 << 20)).alias("line")).where("line <> ''")
    numbers = {k: _field(at).try_cast("long") for k, at in LEVEL_FIELDS.items()}
    known = {k: F.when(~v.isin(*MISSING), v) for k, v in numbers.items()}
    return lines.select("station_no", "time", "profile_no", *(v.alias(k) for k, v in known.items()), *(F.substring("line", *at).alias(k) for k, at in FLAGS.items()))


def write_stations(stations: DataFrame, path: str) -> None:
    text = lambda c, width: F.lpad(c.cast("string"), width, " ")
    row = F.concat_ws(" ", F.lpad(F.col("station_no").cast("string"), 11, "0"), text(F.format_string("%.4f", "latitude"), 8), text(F.format_string("%.4f", "longitude"), 9), text(F.format_string("%.1f", "elevation_m"), 6), F.lit("  "), F.rpad(F.col("name"), 30, " "))
    stations.select(row.alias("value")).write.text(path)


def stations(spark: SparkSession, path: str) -> DataFrame:
    """One row per station id; where it is listed twice, the first by name."""
    rows = spark.read.text(path).withColumnRenamed("value", "line").select(*(_field(at).alias(k) for k, at in STATION_FIELDS.items()))
    typed = rows.select(F.col("station_no").try_cast("long").alias("station_no"), *(F.col(c).try_cast("double").alias(c) for c in ("latitude", "longitude", "elevation_m")), "name")
    return typed.groupBy("station_no").agg(F.min_by(F.struct("latitude", "longitude", "elevation_m", "name"), "name").alias("s")).select("station_no", "s.*")
