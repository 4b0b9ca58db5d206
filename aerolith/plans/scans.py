"""Scans: tables written as fixed-width text or partitioned Parquet and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.sources import levels as src
from aerolith.sources import text

Q: dict = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str):
    def put(f):
        Q[key], SQL[key] = f, sql
        return f

    return put


@query("SC1", f"""WITH {src.LEVELS_SQL} SELECT station_no, profile_no, time, CAST(pressure_hpa * 100 AS BIGINT) AS pressure_pa, CAST(floor(height_m) AS BIGINT) AS height_m, CAST(floor((temperature_k - CAST(273.15 AS DOUBLE)) * 10) AS BIGINT) AS temperature_tenths,
  CAST(relative_humidity * 10 AS BIGINT) AS humidity_tenths, CAST(dewpoint_depression_c * 10 AS BIGINT) AS depression_tenths, pressure_flag, temperature_flag FROM lv""")
def sounding_scan(spark, d):
    rows = src.levels(spark, d).withColumns({
        "pressure_pa": F.col("pressure_hpa") * 100, "height_m": F.floor("height_m"), "temperature_tenths": F.floor((F.col("temperature_k") - 273.15) * 10), "humidity_tenths": F.col("relative_humidity") * 10, "depression_tenths": F.col("dewpoint_depression_c") * 10,
    })
    text.write_soundings(rows, path := text.scratch(spark, "soundings"))
    return text.soundings(spark, path).withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("SC2", f"""WITH {src.LEVELS_SQL}, p AS (SELECT station_no, profile_no, min(time) AS time, count(DISTINCT pressure_hpa) AS n FROM lv GROUP BY ALL)
SELECT station_no, CASE WHEN time < TIMESTAMP '1996-01-01' OR time >= TIMESTAMP '2001-01-01' THEN 'outside_period' WHEN hour(time) NOT IN (0, 12) THEN 'outside_hours' WHEN n < 3 THEN 'insufficient_levels' ELSE 'retained' END AS reason, count(*) AS n FROM p GROUP BY ALL""")
def sounding_counters(spark, d):
    p = src.levels(spark, d).groupBy("station_no", "profile_no").agg(F.min("time").alias("time"), F.count_distinct("pressure_hpa").alias("n"))
    t = F.col("time")
    reason = F.when((t < F.lit("1996-01-01").cast("timestamp")) | (t >= F.lit("2001-01-01").cast("timestamp")), "outside_period").when(~F.hour(t).isin(0, 12), "outside_hours").when(F.col("n") < 3, "insufficient_levels").otherwise("retained")
    return p.groupBy("station_no", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SC3", f"WITH {src.STATIONS_SQL} SELECT station_no, latitude, longitude, elevation_m, 'STATION ' || station_no AS name FROM stations")
def station_scan(spark, d):
    rows = src.stations(spark, d).withColumn("name", F.concat(F.lit("STATION "), F.col("station_no").cast("string")))
    text.write_stations(rows, path := text.scratch(spark, "stations"))
    return text.stations(spark, path)


@query("SC4", f"WITH {src.LEVELS_SQL} SELECT profile_no, pressure_hpa, round(temperature_k, 6) AS temperature_k FROM lv WHERE year(time) = 1997 AND month(time) = 6")
def partitioned_scan(spark, d):
    rows = src.levels(spark, d).withColumn("year", F.year("time")).withColumn("month", F.month("time"))
    rows.select("profile_no", "pressure_hpa", "temperature_k", "height_m", "year", "month").repartition("year", "month").write.partitionBy("year", "month").parquet(path := text.scratch(spark, "levels"))
    return spark.read.parquet(path).where("year = 1997 AND month = 6").select("profile_no", "pressure_hpa", F.round("temperature_k", 6).alias("temperature_k"))
