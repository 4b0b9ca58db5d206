"""Queries over grids, stations and series, keyed by operator, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.operators import sequences, spatial
from aerolith.plans import soundings
from aerolith.plans.soundings import r6
from aerolith.sources import levels as src

Q: dict = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str = ""):
    def put(f):
        Q[key] = f
        if sql:
            SQL[key] = sql
        return f

    return put


_CELLS = f"""{src.GRID_SQL}, {src.TARGETS_SQL},
y AS (SELECT *, greatest(0, least(6, (90 - lat) / 30)) AS y, lon / 30 AS x FROM targets), z AS (SELECT *, least(CAST(floor(y) AS BIGINT), 5) AS a0, CAST(floor(x) AS BIGINT) % 12 AS o0, y - least(floor(y), 5) AS fy, x - floor(x) AS fx FROM y),
cells AS (SELECT id, tpos, a0 AS a, o0 AS o, (1 - fy) * (1 - fx) AS w FROM z UNION ALL SELECT id, tpos, a0, (o0 + 1) % 12, (1 - fy) * fx FROM z
  UNION ALL SELECT id, tpos, a0 + 1, o0, fy * (1 - fx) FROM z UNION ALL SELECT id, tpos, a0 + 1, (o0 + 1) % 12, fy * fx FROM z)"""


@query("JN4", f"WITH {_CELLS} SELECT id, round(sum(w * v), 6) AS value FROM cells JOIN grid ON grid.a = cells.a AND grid.o = cells.o AND grid.t = CAST(floor(tpos) AS BIGINT) GROUP BY 1")
def bilinear(spark, d):
    points = src.targets(spark, d).select("id", F.floor("tpos").alias("t"), "lat", "lon")
    return spatial.bilinear(points, src.grid(spark)).select("id", r6("value", "value"))


@query("JN5", f"""WITH {_CELLS} SELECT id, round(sum(w * v * CASE WHEN grid.t = floor(tpos) THEN 1 - (tpos - floor(tpos)) ELSE tpos - floor(tpos) END), 6) AS value, count(*) AS n_cells
FROM cells JOIN grid ON grid.a = cells.a AND grid.o = cells.o AND grid.t BETWEEN CAST(floor(tpos) AS BIGINT) AND CAST(floor(tpos) AS BIGINT) + 1 GROUP BY 1""")
def spatiotemporal(spark, d):
    return spatial.spatiotemporal(src.targets(spark, d), src.grid(spark)).select("id", r6("value", "value"), "n_cells")


_KM = "2 * CAST(6371.0088 AS DOUBLE) * asin(least(1, sqrt(pow(sin((radians(b.latitude) - radians(a.latitude)) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))"
_PAIRS = f"{src.STATIONS_SQL}, pairs AS (SELECT a.station_no AS target, b.station_no AS neighbour, {_KM} AS km FROM stations a JOIN stations b ON a.station_no <> b.station_no), near AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(km, 6), neighbour) AS rank FROM pairs)"


@query("JN11", f"""WITH {soundings.VALID}, r AS (SELECT DISTINCT profile_no, station_no, time, pressure_hpa, latitude, longitude FROM lvv WHERE valid),
p AS (SELECT a.profile_no, a.pressure_hpa, b.profile_no AS neighbour, {_KM} AS km FROM r a JOIN r b ON a.time = b.time AND a.pressure_hpa = b.pressure_hpa AND a.station_no <> b.station_no),
k AS (SELECT *, row_number() OVER (PARTITION BY profile_no, pressure_hpa ORDER BY round(km, 6), neighbour) AS rank FROM p) SELECT profile_no, pressure_hpa, neighbour, rank, round(km, 6) AS km FROM k WHERE rank <= 8""")
def nearest(spark, d):
    """The eight nearest reports of other stations at the same time and level. A top-k report: the limit is what the operator is for."""
    r = soundings.valid(spark, d).where("valid").select("profile_no", "station_no", "time", "pressure_hpa", "latitude", "longitude").distinct()
    near = spatial.nearest(r, r, "profile_no", 8, ("time", "pressure_hpa"), "station_no")
    return near.select(F.col("target").alias("profile_no"), "pressure_hpa", "neighbour", F.col("rank").cast("long").alias("rank"), r6("km", "km"))


@query("JN13", f"WITH {_PAIRS} SELECT target, round(min(km), 6) AS nearest_km, count(*) FILTER (km <= 500) AS within_500, count(*) FILTER (km <= 1000) AS within_1000 FROM pairs GROUP BY 1")
def support(spark, d):
    s = src.stations(spark, d)
    return spatial.nearest(s, s, "station_no", 1).select("target", r6("km", "nearest_km")).join(spatial.within(s, s, "station_no", (500.0, 1000.0)), "target")


@query("ML8", f"""WITH {_PAIRS}, {src.SERIES_SQL}, v AS (SELECT station AS neighbour, avg(value) AS value FROM series GROUP BY 1)
SELECT target, round(sum(value / pow(greatest(km, CAST(1e-3 AS DOUBLE)), 2)) / sum(1 / pow(greatest(km, CAST(1e-3 AS DOUBLE)), 2)), 6) AS prediction, count(*) AS n FROM near JOIN v USING (neighbour) WHERE rank <= 8 GROUP BY 1""")
def inverse_distance(spark, d):
    s = src.stations(spark, d)
    values = src.series(spark, d).groupBy(F.col("station").alias("neighbour")).agg(F.avg("value").alias("value"))
    return spatial.inverse_distance(spatial.neighbours(s, s, "station_no", 8), values).select("target", r6("prediction", "prediction"), "n")


@query("WN5", f"""WITH {src.SERIES_SQL}, g AS (SELECT *, CASE WHEN (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / CAST(3.6e9 AS DOUBLE) > 12 + 1e-6 THEN 1 ELSE 0 END AS new FROM series WINDOW w AS (PARTITION BY station ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY station ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM g) SELECT station, CAST(segment AS BIGINT) AS segment, count(*) AS n FROM s GROUP BY ALL""")
def gap_segments(spark, d):
    return sequences.segments(src.series(spark, d), "station", "ts", "event_id", 12).groupBy("station", F.col("segment").cast("long").alias("segment")).agg(F.count("*").alias("n"))


@query("WN3", f"""WITH {src.SERIES_SQL}, w AS (SELECT event_id, count(*) OVER f AS n, sum(value) OVER f AS x, lead(value, 3) OVER (PARTITION BY station ORDER BY ts, event_id) AS y FROM series WINDOW f AS (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT event_id, round(x, 6) AS x_sum, round(y, 6) AS y FROM w WHERE n = 8 AND y IS NOT NULL""")
def supervised(spark, d):
    rows = sequences.supervised(src.series(spark, d), ["station"], ["ts", "event_id"], "value", 8, 3)
    return rows.select("event_id", r6(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), "x_sum"), r6("y", "y"))


@query("WN8", f"""WITH {src.SERIES_SQL}, f AS (SELECT layer, value AS p, avg(value) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m, CASE WHEN lag(value, 7) OVER w IS NOT NULL THEN value + 3 * greatest(-1, least(1, (value - lag(value, 7) OVER w) / 7)) END AS t, lead(value, 3) OVER w AS y FROM series WINDOW w AS (PARTITION BY station ORDER BY ts, event_id))
SELECT layer, count(*) AS n, round(sqrt(avg(pow(p - y, 2))), 6) AS persistence, round(sqrt(avg(pow(m - y, 2))), 6) AS recent_mean, round(sqrt(avg(pow(t - y, 2))), 6) AS trend FROM f WHERE y IS NOT NULL AND t IS NOT NULL GROUP BY 1""")
def simple_forecasts(spark, d):
    rows = sequences.forecasts(src.series(spark, d), ["station"], ["ts", "event_id"], "value", 7, 3, 1.0).where("truth IS NOT NULL AND trend IS NOT NULL")
    rmse = lambda c: r6(F.sqrt(F.avg(F.pow(F.col(c) - F.col("truth"), F.lit(2)))), c)
    return rows.groupBy("layer").agg(F.count("*").alias("n"), rmse("persistence"), rmse("recent_mean"), rmse("trend"))


@query("WN9", f"""WITH {src.SERIES_SQL}, s AS (SELECT station, row_number() OVER (PARTITION BY station ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY station) AS n FROM series)
SELECT station, CASE WHEN i < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN i < floor(n * CAST(0.85 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS part, count(*) AS n FROM s GROUP BY ALL""")
def chronological(spark, d):
    return sequences.split(src.series(spark, d), "station", ["ts", "event_id"], 0.7, 0.15).groupBy("station", "part").agg(F.count("*").alias("n"))


@query("AG3", f"""WITH {src.SERIES_SQL}, f AS (SELECT layer, h, value AS p, lead(value, CAST(h AS INT)) OVER (PARTITION BY station, h ORDER BY ts, event_id) AS y FROM series, (SELECT unnest([1, 3]) AS h))
SELECT coalesce(layer, 'all') AS layer, coalesce(CAST(h AS VARCHAR), 'all') AS horizon, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS mse, round(sqrt(avg(pow(p - y, 2))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae, round(100 * avg(abs(p - y) / greatest(abs(y), CAST(1e-8 AS DOUBLE))), 6) AS mape
FROM f WHERE y IS NOT NULL GROUP BY CUBE (layer, h)""")
def scopes(spark, d):
    s = src.series(spark, d)
    parts = [sequences.forecasts(s, ["station"], ["ts", "event_id"], "value", 7, h, 1.0).select("layer", F.lit(h).alias("h"), F.col("persistence").alias("p"), F.col("truth").alias("y")) for h in (1, 3)]
    e = F.col("p") - F.col("y")
    out = parts[0].unionByName(parts[1]).where("y IS NOT NULL").cube("layer", "h").agg(
        F.count("*").alias("n"), r6(F.avg(e * e), "mse"), r6(F.sqrt(F.avg(e * e)), "rmse"), r6(F.avg(F.abs(e)), "mae"), r6(100 * F.avg(F.abs(e) / F.greatest(F.abs(F.col("y")), F.lit(1e-8))), "mape")
    )
    return out.withColumns({"layer": F.coalesce("layer", F.lit("all")), "horizon": F.coalesce(F.col("h").cast("string"), F.lit("all"))}).drop("h")


@query("ST2", f"""WITH {src.SERIES_SQL}, g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM series WINDOW w AS (PARTITION BY station ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY station ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT station, min(ts) AS first_time, count(*) AS n, round(avg(value), 6) AS value FROM s GROUP BY station, k""")
def gap_sessions(spark, d):
    """The batch form; streaming.sessions runs the same grouping on a stream with a watermark."""
    from aerolith.streaming.series import sessions

    return sessions(src.series(spark, d)).select("station", F.col("first_time").cast("timestamp_ntz").alias("first_time"), "n", r6("value", "value"))
