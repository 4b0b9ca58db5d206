"""Queries that select, expand, pair, order and stack level tables, keyed by operator, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from aerolith.functions import geo
from aerolith.operators import protocols, resampling, sequences, spatial
from aerolith.plans.soundings import CAL, DEV, OBS, PRED, observed, predicted, r6
from aerolith.sources import levels as src

Q: dict = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str):
    def put(f):
        Q[key], SQL[key] = f, sql
        return f

    return put


def _at(text: str):
    return F.lit(text).cast("timestamp")


@query("PF2", f"WITH {src.LEVELS_SQL} SELECT profile_no AS id, pressure_hpa AS p, round(temperature_k, 6) AS t FROM lv")
def aliases(spark, d):
    """Names resolved from lists of candidates, the first that is there, letter case aside."""
    rows = src.levels(spark, d)
    wanted = {"id": ("sounding_id", "PROFILE_NO"), "p": ("level", "Pressure_hPa"), "t": ("temperature_k", "temp")}
    there = {c.lower(): c for c in rows.columns}
    names = {there[next(c.lower() for c in cs if c.lower() in there)]: k for k, cs in wanted.items()}
    return rows.select(*names).withColumnsRenamed(names).withColumn("t", F.round("t", 6))


_UNITS = f"""{src.LEVELS_SQL}, x AS (SELECT profile_no, profile_no % 3 AS k, CAST(pressure_hpa AS DOUBLE) * CASE profile_no % 3 WHEN 0 THEN 1 ELSE 100 END AS p, temperature_k - CASE profile_no % 3 WHEN 0 THEN 0 ELSE CAST(273.15 AS DOUBLE) END AS t,
  q * CASE profile_no % 3 WHEN 0 THEN 1 ELSE 1000 END AS h, height_m / CASE profile_no % 3 WHEN 0 THEN 1 ELSE CAST(1000 AS DOUBLE) END AS z FROM lv),
m AS (SELECT *, k = 1 AS told, median(p) OVER w AS mp, median(t) OVER w AS mt, quantile_cont(h, 0.95) OVER w AS mh, median(abs(z)) OVER w AS mz FROM x WINDOW w AS (PARTITION BY profile_no))"""


@query("PF3", f"""WITH {_UNITS} SELECT profile_no, round(sum(CASE WHEN told OR mp > 2000 THEN p / 100 ELSE p END), 4) AS p, round(sum(CASE WHEN told OR mt < 100 THEN t + CAST(273.15 AS DOUBLE) ELSE t END), 4) AS t,
round(sum(CASE WHEN told OR mh > 0.2 THEN h / 1000 ELSE h END), 6) AS h, round(sum(CASE WHEN told OR mz < 200 THEN z * 1000 ELSE z END), 4) AS z FROM m GROUP BY 1""")
def units(spark, d):
    """A third of the profiles is in the right units and says so, a third in others and says so, a third in others and says nothing."""
    k = F.col("profile_no") % 3
    other = lambda a, b: F.when(k == 0, a).otherwise(b)
    told = lambda right, wrong: F.when(k == 0, right).when(k == 1, wrong)
    rows = src.levels(spark, d).select(
        "profile_no", (F.col("pressure_hpa").cast("double") * other(1, 100)).alias("p"), (F.col("temperature_k") - other(0.0, 273.15)).alias("t"), (F.col("q") * other(1, 1000)).alias("h"), (F.col("height_m") / other(1.0, 1000.0)).alias("z"),
        told("hPa", "Pa").alias("p_unit"), told("K", "deg C").alias("t_unit"), told("kg/kg", "g / kg").alias("h_unit"), told("m", "km").alias("z_unit"),
    )
    kinds = {"p": "pressure", "t": "temperature", "h": "humidity", "z": "height"}
    right = rows.select("profile_no", *(protocols.converted(F.col(c), F.col(f"{c}_unit"), kind, ["profile_no"]).alias(c) for c, kind in kinds.items()))
    return right.groupBy("profile_no").agg(*(F.round(F.sum(c), 6 if c == "h" else 4).alias(c) for c in kinds))


@query("PF10", f"WITH {OBS} SELECT profile_no, count(*) FILTER (valid AND NOT below_ground) AS n_eval FROM obs GROUP BY 1")
def evaluation_rows(spark, d):
    return observed(spark, d).groupBy("profile_no").agg(F.count_if(F.col("valid") & ~F.col("below_ground")).alias("n_eval"))


@query("PF13", f"""WITH {OBS}, v AS (SELECT profile_no, pressure_hpa, valid AND surface_pressure_pa - x >= pressure_hpa * 100 AS mask FROM obs, (SELECT unnest([0, 1000, 3000]) AS x)), c AS (SELECT profile_no, pressure_hpa, bool_and(mask) AS common, count(*) FILTER (mask) AS n FROM v GROUP BY ALL)
SELECT pressure_hpa, common, n AS variants, count(*) AS n_rows FROM c GROUP BY ALL""")
def common_sample(spark, d):
    v = observed(spark, d).select("profile_no", "pressure_hpa", "valid", "surface_pressure_pa", F.explode(F.array(F.lit(0), F.lit(1000), F.lit(3000))).alias("x"))
    v = v.withColumn("mask", F.col("valid") & (F.col("surface_pressure_pa") - F.col("x") >= F.col("pressure_hpa") * 100))
    c = v.groupBy("profile_no", "pressure_hpa").agg(F.bool_and("mask").alias("common"), F.count_if("mask").alias("variants"))
    return c.groupBy("pressure_hpa", "common", "variants").agg(F.count("*").alias("n_rows"))


#: Protocol, phase, role, first time, first time after it; the block of those that need one.
_LICENCES = (
    ("space", "fit", "train", "1995-01-01", DEV), ("space", "score", "test", "1995-01-01", DEV), ("time", "score", "train", CAL, "2003-01-01"),
    ("block", "fit", "block_out", "1995-01-01", DEV), ("block", "calibrate", "block_out_calibration", DEV, CAL), ("block", "score", "block_in", CAL, "2003-01-01"),
)
_BLOCK = "lat3_lon1"
_IN_BLOCK = "least(greatest(floor((latitude + 90) / 30), 0), 5) = 3 AND least(greatest(floor((longitude - 360 * floor(longitude / 360)) / 60), 0), 5) = 1"
_LINES = ", ".join(f"('{p}', '{ph}', {'NULL' if protocols.BLOCK_ROLES.get(r, (r,))[0] is None else repr(protocols.BLOCK_ROLES.get(r, (r,))[0])}, {'NULL' if r not in protocols.BLOCK_ROLES else str(protocols.BLOCK_ROLES[r][1])}, TIMESTAMP '{a}', TIMESTAMP '{b}')" for p, ph, r, a, b in _LICENCES)


@query("PF16", f"""WITH {src.STATIONS_SQL}, s AS (SELECT station_no, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.7) + floor(n * 0.1) THEN 'calibration' ELSE 'test' END AS role FROM (SELECT station_no, row_number() OVER (ORDER BY md5('42:' || station_no), station_no) - 1 AS i, count(*) OVER () AS n FROM stations)), {src.LEVELS_SQL},
l AS (SELECT * FROM (VALUES {_LINES}) t(protocol, phase, role, inside, lo, hi))
SELECT protocol, phase, count(*) AS n, count(DISTINCT station_no) AS stations FROM lv JOIN s USING (station_no) JOIN l ON coalesce(l.role = s.role, true) AND coalesce(inside = ({_IN_BLOCK}), true) AND time >= lo AND time < hi GROUP BY ALL""")
def licences(spark, d):
    """Rows by the phases that license them, the block-in and block-out ones among them."""
    roles = resampling.split(src.stations(spark, d), "station_no", 42).select("station_no", "role")
    found = protocols.licensed(src.levels(spark, d), roles, list(_LICENCES), _BLOCK)
    return found.groupBy("protocol", "phase").agg(F.count("*").alias("n"), F.count_distinct("station_no").alias("stations"))


@query("PF17", f"WITH {src.LEVELS_SQL} SELECT time >= TIMESTAMP '1997-03-01' AND time < TIMESTAMP '1997-09-01' AS blocked, count(*) AS n FROM lv GROUP BY 1")
def scenario(spark, d):
    t = F.col("time")
    return src.levels(spark, d).groupBy(((t >= _at("1997-03-01")) & (t < _at("1997-09-01"))).alias("blocked")).agg(F.count("*").alias("n"))


@query("PF19", f"""WITH {src.STATIONS_SQL}, m AS (SELECT station_no, latitude * CAST(1.3 AS DOUBLE) AS latitude, longitude * CAST(1.05 AS DOUBLE) AS longitude, CASE WHEN elevation_m < 3000 THEN elevation_m - 600 END AS elevation_m FROM stations),
c AS (SELECT *, concat_ws(';', CASE WHEN abs(latitude) > 90 THEN 'invalid_latitude' END, CASE WHEN abs(longitude) > 180 THEN 'invalid_longitude' END) AS reason, CASE WHEN elevation_m BETWEEN -500 AND 9000 THEN '' ELSE 'missing_station_elevation' END AS issue FROM m)
SELECT 'kept' AS "table", station_no, CASE WHEN issue = '' THEN round(elevation_m, 6) END AS elevation_m, issue AS note FROM c WHERE reason = '' UNION ALL SELECT 'excluded', station_no, round(elevation_m, 6), reason FROM c WHERE reason <> '' UNION ALL SELECT 'issues', station_no, round(elevation_m, 6), issue FROM c WHERE issue <> ''""")
def metadata(spark, d):
    """Station lists whose coordinates are stretched, so that some are impossible: kept, excluded and issue rows."""
    m = src.stations(spark, d).select("station_no", (F.col("latitude") * 1.3).alias("latitude"), (F.col("longitude") * 1.05).alias("longitude"), F.when(F.col("elevation_m") < 3000, F.col("elevation_m") - 600).alias("elevation_m"))
    note = {"kept": "metadata_issue", "excluded": "exclusion_reason", "issues": "metadata_issue"}
    parts = [t.select(F.lit(k).alias("table"), "station_no", F.round("elevation_m", 6).alias("elevation_m"), F.col(c).alias("note")) for (k, c), t in zip(note.items(), protocols.stations_by_use(m), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("JN2", f"WITH {OBS}, {src.STATIONS_SQL} SELECT CASE WHEN s.latitude >= 30 THEN 'north' WHEN s.latitude <= -30 THEN 'south' ELSE 'tropics' END AS region, count(*) AS n, round(avg(s.elevation_m), 6) AS elevation FROM obs JOIN stations s USING (station_no) GROUP BY 1")
def dimension(spark, d):
    rows = observed(spark, d).select("station_no").join(F.broadcast(src.stations(spark, d)), "station_no")
    return rows.groupBy(geo.region(F.col("latitude")).alias("region")).agg(F.count("*").alias("n"), r6(F.avg("elevation_m"), "elevation"))


@query("JN6", f"""WITH {src.STATIONS_SQL}, {src.FIELD_SQL}, f AS (SELECT a, o, avg(v) AS v FROM field GROUP BY ALL), y AS (SELECT *, greatest(0, least(6, (90 - latitude) / 30)) AS y, (longitude - 360 * floor(longitude / 360)) / 30 AS x FROM stations),
z AS (SELECT *, least(CAST(floor(y) AS BIGINT), 5) AS a0, CAST(floor(x) AS BIGINT) % 12 AS o0, y - least(floor(y), 5) AS fy, x - floor(x) AS fx FROM y),
c AS (SELECT station_no, a0 AS a, o0 AS o, (1 - fy) * (1 - fx) AS w FROM z UNION ALL SELECT station_no, a0, (o0 + 1) % 12, (1 - fy) * fx FROM z UNION ALL SELECT station_no, a0 + 1, o0, fy * (1 - fx) FROM z UNION ALL SELECT station_no, a0 + 1, (o0 + 1) % 12, fy * fx FROM z),
b AS (SELECT station_no, sum(w * v) / sum(w) AS height FROM c JOIN f USING (a, o) GROUP BY 1), n AS (SELECT station_no, v FROM stations JOIN f ON a = CAST(floor((90 - latitude) / 30 + 0.5) AS BIGINT) AND o = CAST(floor(((longitude % 360 + 360) % 360) / 30 + 0.5) AS BIGINT) % 12)
SELECT station_no, round(height, 6) AS height, round(v, 6) AS nearest, CASE WHEN v >= 25.5 THEN 'land' ELSE 'sea' END AS surface FROM b JOIN n USING (station_no)""")
def static_fields(spark, d):
    """Surface height between four cells, land or sea by the nearest one. A static field is 84 cells here, a row each, and fits into a broadcast."""
    field = src.field(spark, d).groupBy("a", "o").agg(F.avg("v").alias("v"))
    s = src.stations(spark, d)
    cells = s.select("station_no", F.explode(spatial.corners(F.col("latitude"), F.col("longitude"))).alias("c")).select("station_no", "c.*")
    height = cells.join(F.broadcast(field), ["a", "o"]).groupBy("station_no").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("height"))
    cell = s.select("station_no", F.floor((90 - F.col("latitude")) / 30 + 0.5).alias("a"), (F.floor(F.pmod("longitude", F.lit(360.0)) / 30 + 0.5) % 12).alias("o"))
    near = cell.join(F.broadcast(field), ["a", "o"]).select("station_no", "v")
    return height.join(near, "station_no").select("station_no", r6("height", "height"), r6("v", "nearest"), F.when(F.col("v") >= 25.5, "land").otherwise("sea").alias("surface"))


@query("JN8", f"WITH {src.TARGETS_SQL}, l AS (SELECT unnest([1000, 925, 850, 700, 500, 300]) AS pressure_hpa) SELECT id, pressure_hpa FROM targets CROSS JOIN l")
def expand_levels(spark, d):
    return src.targets(spark, d).select("id", F.explode(F.array(*(F.lit(p) for p in src.LEVELS))).alias("pressure_hpa"))


@query("JN19", f"WITH {OBS}, c AS (SELECT station_no, pressure_hpa FROM obs WHERE valid GROUP BY ALL HAVING count(*) >= 40) SELECT pressure_hpa, count(*) AS n, count(DISTINCT station_no) AS stations FROM obs SEMI JOIN c USING (station_no, pressure_hpa) GROUP BY 1")
def matched_rows(spark, d):
    rows = observed(spark, d)
    cells = rows.where("valid").groupBy("station_no", "pressure_hpa").agg(F.count("*").alias("k")).where("k >= 40")
    return rows.join(cells, ["station_no", "pressure_hpa"], "left_semi").groupBy("pressure_hpa").agg(F.count("*").alias("n"), F.count_distinct("station_no").alias("stations"))


@query("JN23", f"""WITH {PRED}, s AS (SELECT seed, sqrt(avg(pow(error + seed % 7 * CAST(0.01 AS DOUBLE), 2))) AS a, sqrt(avg(pow(residual_total - seed % 7 * CAST(0.01 AS DOUBLE), 2))) AS b FROM pred, (SELECT unnest([11, 23, 42]) AS seed) GROUP BY 1) SELECT seed, round(a, 6) AS model, round(b, 6) AS background, round(a - b, 6) AS delta FROM s""")
def paired_runs(spark, d):
    rows = predicted(spark, d).select("error", "residual_total", F.explode(F.array(*(F.lit(s) for s in (11, 23, 42)))).alias("seed"))
    shift = F.col("seed") % 7 * 0.01
    rmse = lambda e: F.sqrt(F.avg(e * e))
    a, b = (rows.groupBy("seed").agg(rmse(e).alias(k)) for k, e in (("a", F.col("error") + shift), ("b", F.col("residual_total") - shift)))
    return a.join(b, "seed").select("seed", r6("a", "model"), r6("b", "background"), r6(F.col("a") - F.col("b"), "delta"))


@query("WN4", f"""WITH {src.SERIES_SQL}, g AS (SELECT *, CASE WHEN (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / CAST(3.6e9 AS DOUBLE) > 12 + 1e-6 THEN 1 ELSE 0 END AS new FROM series WINDOW w AS (PARTITION BY station ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY station ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM g), w AS (SELECT station, segment, count(*) OVER f AS n, lead(value, 1) OVER (PARTITION BY station, segment ORDER BY ts, event_id) AS y FROM s WINDOW f AS (PARTITION BY station, segment ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT station, CAST(segment AS BIGINT) AS segment, count(*) AS windows FROM w WHERE n = 3 AND y IS NOT NULL GROUP BY ALL""")
def segment_windows(spark, d):
    rows = sequences.segments(src.series(spark, d), "station", "ts", "event_id", 12)
    w = sequences.supervised(rows, ["station", "segment"], ["ts", "event_id"], "value", 3, 1)
    return w.groupBy("station", F.col("segment").cast("long").alias("segment")).agg(F.count("*").alias("windows"))


@query("WN16", f"""WITH {src.TARGETS_SQL}, t AS (SELECT id % 50 AS track, id, CAST((id * 47) % 360 - 180 AS DOUBLE) AS lon FROM targets),
u AS (SELECT track, id, lon, coalesce(round((lon - lag(lon) OVER (PARTITION BY track ORDER BY id)) / 360), 0) AS j FROM t) SELECT id, round(lon - 360 * sum(j) OVER (PARTITION BY track ORDER BY id ROWS UNBOUNDED PRECEDING), 6) AS lon FROM u""")
def unwrap(spark, d):
    t = src.targets(spark, d).select((F.col("id") % 50).alias("track"), "id", ((F.col("id") * 47) % 360 - 180).cast("double").alias("lon"))
    by = Window.partitionBy("track").orderBy("id")
    u = t.withColumn("j", F.coalesce(F.round((F.col("lon") - F.lag("lon").over(by)) / 360), F.lit(0.0)))
    return u.select("id", r6(F.col("lon") - 360 * F.sum("j").over(by.rowsBetween(Window.unboundedPreceding, 0)), "lon"))


@query("SL3", f"WITH {src.LEVELS_SQL} SELECT station_no, count(*) AS n FROM (SELECT station_no, dense_rank() OVER (PARTITION BY station_no ORDER BY time) AS k FROM lv) WHERE k <= 5 GROUP BY 1")
def first_times(spark, d):
    """A top-k report: rows of the first five times of each station."""
    k = F.dense_rank().over(Window.partitionBy("station_no").orderBy("time"))
    return src.levels(spark, d).select("station_no", k.alias("k")).where("k <= 5").groupBy("station_no").agg(F.count("*").alias("n"))


@query("SL6", f"WITH {src.LEVELS_SQL}, p AS (SELECT DISTINCT pressure_hpa, station_no FROM lv) SELECT pressure_hpa, station_no FROM p QUALIFY row_number() OVER (PARTITION BY pressure_hpa ORDER BY md5('7:' || station_no), station_no) <= 10")
def stratified(spark, d):
    """A sampling operator: ten stations of each level in hash order."""
    by = Window.partitionBy("pressure_hpa").orderBy(F.md5(F.concat_ws(":", F.lit("7"), F.col("station_no").cast("string"))), "station_no")
    return src.levels(spark, d).select("pressure_hpa", "station_no").distinct().withColumn("k", F.row_number().over(by)).where("k <= 10").drop("k")


@query("SO1", f"WITH {OBS} SELECT source, count(*) AS n, count(x) AS n_x FROM (SELECT 'warm' AS source, temperature_k AS x FROM obs WHERE temperature_k > 280 UNION ALL SELECT 'cold', NULL FROM obs WHERE temperature_k <= 280) GROUP BY 1")
def stacked(spark, d):
    rows = observed(spark, d)
    warm = rows.where("temperature_k > 280").select(F.lit("warm").alias("source"), F.col("temperature_k").alias("x"))
    cold = rows.where("temperature_k <= 280").select(F.lit("cold").alias("source"))
    return warm.unionByName(cold, allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"), F.count("x").alias("n_x"))


@query("SO2", f"WITH {src.LEVELS_SQL} SELECT DISTINCT station_no, pressure_hpa FROM lv")
def keys(spark, d):
    return src.levels(spark, d).select("station_no", "pressure_hpa").distinct()


@query("AR16", f"WITH {src.LEVELS_SQL}, f AS (SELECT DISTINCT pressure_hpa, q FROM lv), s AS (SELECT *, q * q * pressure_hpa AS score FROM f) SELECT lv.pressure_hpa, count(*) AS n, count(DISTINCT lv.q) AS distinct_rows, round(sum(score), 6) AS score FROM lv JOIN s ON s.pressure_hpa = lv.pressure_hpa AND s.q = lv.q GROUP BY 1")
def score_once(spark, d):
    rows = src.levels(spark, d).select("pressure_hpa", "q")
    scored = rows.distinct().withColumn("score", F.col("q") * F.col("q") * F.col("pressure_hpa"))
    return rows.join(scored, ["pressure_hpa", "q"]).groupBy("pressure_hpa").agg(F.count("*").alias("n"), F.count_distinct("q").alias("distinct_rows"), r6(F.sum("score"), "score"))
