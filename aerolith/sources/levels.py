"""Sounding levels, stations, series, grid and prediction rows as DataFrames over the star-schema tables, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The standard pressure levels (hPa) and their nominal heights (m).
LEVELS = (1000, 925, 850, 700, 500, 300)
HEIGHTS = (111, 762, 1457, 3012, 5574, 9164)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table with timestamps as instants (UTC sessions); only the named columns are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*(columns or "*"))
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def lookup(index: Column, values: tuple) -> Column:
    """values[index - 1]"""
    return F.element_at(F.array(*(F.lit(v) for v in values)), index)


#: Rows of lineitem that a task of a join by order gets.
TASK_ROWS = 250_000


def by_order(spark: SparkSession, sf_dir: str, lines: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both dealt by order to as many tasks as the lines need (their number is in the file's footers), so that a task's share doesn't grow with the tables; few lines are left to Spark."""
    tasks = -(-table(spark, sf_dir, "lineitem", "l_orderkey").count() // TASK_ROWS)
    if tasks <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return lines, orders
    return lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per level report: a profile (station and time) has up to six levels, some reported twice."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    p, h = lookup(F.col("l_linenumber"), LEVELS), lookup(F.col("l_linenumber"), HEIGHTS)
    station = F.col("o_custkey") % 120
    lines, orders = by_order(spark, sf_dir, lines.where("l_linenumber <= 6"), orders)
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(
        F.col("l_orderkey").alias("profile_no"), station.alias("station_no"), F.col("l_linenumber").alias("line_no"), F.col("l_extendedprice").alias("line_value"),
        (F.col("o_orderdate") + F.make_interval(hours=(F.col("l_orderkey") % 2 * 12).cast("int"))).alias("time"),
        p.alias("pressure_hpa"), (210 + p * 0.08 + (F.col("l_quantity") - 25) * 0.2).alias("temperature_k"), (F.col("l_discount") * p / 10000).alias("q"),
        (h + F.col("l_quantity")).alias("height_m"), F.col("l_tax").alias("tax"), (F.lit(95000) + (F.col("l_orderkey") % 13) * 1000).alias("surface_pressure_pa"),
        F.col("l_returnflag").alias("pressure_flag"), F.col("l_linestatus").alias("temperature_flag"),
        F.when(F.col("l_linestatus") == "F", F.col("l_partkey") % 30).cast("double").alias("dewpoint_depression_c"), (F.col("l_suppkey") % 100 + 20).cast("double").alias("relative_humidity"),
        ((station * 37) % 150 - 75).cast("double").alias("latitude"), ((station * 53) % 360 - 180).cast("double").alias("longitude"), ((station * 71) % 3500).cast("double").alias("elevation_m"),
    )
    return rows.withColumn("bg_temperature_k", F.col("temperature_k") + (F.col("tax") - 0.04) * 20).withColumn("bg_q", F.greatest(F.col("q") + (F.col("tax") - 0.04) * F.col("pressure_hpa") / 50000, F.lit(0.0)))


def _case(of: str, values: tuple) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i + 1} THEN {v}" for i, v in enumerate(values)) + " END"


LEVELS_SQL = f"""lv0 AS (SELECT l_orderkey AS profile_no, o_custkey % 120 AS station_no, l_linenumber AS line_no, l_extendedprice AS line_value,
  o_orderdate + to_hours(CAST(l_orderkey % 2 * 12 AS INT)) AS time, {_case("l_linenumber", LEVELS)} AS pressure_hpa,
  {_case("l_linenumber", HEIGHTS)} + l_quantity AS height_m, l_quantity, l_discount, l_tax AS tax, 95000 + (l_orderkey % 13) * 1000 AS surface_pressure_pa,
  l_returnflag AS pressure_flag, l_linestatus AS temperature_flag, CASE WHEN l_linestatus = 'F' THEN CAST(l_partkey % 30 AS DOUBLE) END AS dewpoint_depression_c,
  CAST(l_suppkey % 100 + 20 AS DOUBLE) AS relative_humidity, CAST((o_custkey % 120 * 37) % 150 - 75 AS DOUBLE) AS latitude,
  CAST((o_custkey % 120 * 53) % 360 - 180 AS DOUBLE) AS longitude, CAST((o_custkey % 120 * 71) % 3500 AS DOUBLE) AS elevation_m
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 6),
lv1 AS (SELECT *, 210 + pressure_hpa * CAST(0.08 AS DOUBLE) + (l_quantity - 25) * CAST(0.2 AS DOUBLE) AS temperature_k, l_discount * pressure_hpa / 10000 AS q FROM lv0),
lv AS (SELECT *, temperature_k + (tax - CAST(0.04 AS DOUBLE)) * 20 AS bg_temperature_k, greatest(q + (tax - CAST(0.04 AS DOUBLE)) * pressure_hpa / 50000, 0) AS bg_q FROM lv1)"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station_no, latitude, longitude, elevation_m: one row per station, at most 120."""
    n = table(spark, sf_dir, "orders", "o_custkey").select((F.col("o_custkey") % 120).alias("station_no")).distinct()
    return n.select("station_no", ((F.col("station_no") * 37) % 150 - 75).cast("double").alias("latitude"), ((F.col("station_no") * 53) % 360 - 180).cast("double").alias("longitude"), ((F.col("station_no") * 71) % 3500).cast("double").alias("elevation_m"))


STATIONS_SQL = """stations AS (SELECT DISTINCT o_custkey % 120 AS station_no, CAST((o_custkey % 120 * 37) % 150 - 75 AS DOUBLE) AS latitude,
  CAST((o_custkey % 120 * 53) % 360 - 180 AS DOUBLE) AS longitude, CAST((o_custkey % 120 * 71) % 3500 AS DOUBLE) AS elevation_m FROM orders)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, ts, event_id, value, layer."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("station"), "ts", "event_id", "value", F.col("event_type").alias("layer"))


SERIES_SQL = "series AS (SELECT user_id AS station, ts, event_id, value, event_type AS layer FROM events)"


def grid(spark: SparkSession) -> DataFrame:
    """t, a (latitude index, 90 down to -90 by 30), o (longitude index by 30), v: 125 slices of 6 hours."""
    cells = spark.range(125).withColumnRenamed("id", "t").crossJoin(spark.range(7).withColumnRenamed("id", "a")).crossJoin(spark.range(12).withColumnRenamed("id", "o"))
    return cells.withColumn("v", ((F.col("t") * 7 + F.col("a") * 13 + F.col("o") * 29) % 101) * F.lit(0.1))


GRID_SQL = """grid AS (SELECT t, a, o, ((t * 7 + a * 13 + o * 29) % 101) * CAST(0.1 AS DOUBLE) AS v
  FROM range(125) x(t), range(7) y(a), range(12) z(o))"""


def field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, a, o, v: a gridded field made of a given table, the mean quantity of the lines that fall into each of 12 times and 84 cells."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    cell = F.col("l_partkey") % 84
    return lines.groupBy((F.col("l_orderkey") % 12).alias("t"), F.floor(cell / 12).alias("a"), (cell % 12).alias("o")).agg(F.avg("l_quantity").cast("double").alias("v"))


FIELD_SQL = "field AS (SELECT l_orderkey % 12 AS t, l_partkey % 84 // 12 AS a, l_partkey % 84 % 12 AS o, CAST(avg(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY ALL)"


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in space and time that take values from the grid: id, lat, lon, tpos (slices since the first)."""
    return places(table(spark, sf_dir, "events", "event_id", "user_id", "ts"))


def places(e: DataFrame) -> DataFrame:
    """Events, of a table or a stream, as targets."""
    seconds = (F.unix_micros("ts") - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1e6
    return e.select(F.col("event_id").alias("id"), (F.lit(-85) + (F.col("user_id") * 37) % 170).cast("double").alias("lat"), ((F.col("user_id") * 53) % 360 + 0.5).alias("lon"), (seconds / 21600).alias("tpos"))


TARGETS_SQL = """targets AS (SELECT event_id AS id, CAST(-85 + (user_id * 37) % 170 AS DOUBLE) AS lat, CAST((user_id * 53) % 360 + 0.5 AS DOUBLE) AS lon,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / CAST(1e6 AS DOUBLE) / 21600 AS tpos FROM events)"""
