"""Queries over sounding levels, keyed by operator, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.functions import atmosphere, geo, scores
from aerolith.operators import metrics, profiles, quantiles, resampling
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


def r6(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def _n(t: str, q: str, p: str = "pressure_hpa") -> tuple[str, str]:
    e = f"({q} * {p} / (CAST(0.622 AS DOUBLE) + CAST(0.378 AS DOUBLE) * {q}))"
    return f"(CAST(77.6 AS DOUBLE) * {p} / {t})", f"(CAST(3.73e5 AS DOUBLE) * {e} / ({t} * {t}))"


_OD, _OW = _n("temperature_k", "q")
_BD, _BW = _n("bg_temperature_k", "bg_q")
_ES = "(CAST(6.112 AS DOUBLE) * exp(CAST(17.67 AS DOUBLE) * ({0}) / (({0}) + CAST(243.5 AS DOUBLE))))"
VALID = f"""{src.LEVELS_SQL},
lvv AS (SELECT *, temperature_k - CAST(273.15 AS DOUBLE) > -120 AND temperature_k - CAST(273.15 AS DOUBLE) < 60 AND height_m IS NOT NULL
  AND coalesce(dewpoint_depression_c >= 0 OR relative_humidity BETWEEN 0 AND 110, false) AS valid FROM lv)"""
OBS = f"""{VALID},
obs AS (SELECT *, surface_pressure_pa < pressure_hpa * 100 AS below_ground, obs_dry + obs_wet AS obs_total, bg_dry + bg_wet AS bg_total, obs_dry - bg_dry AS residual_dry,
  obs_wet - bg_wet AS residual_wet, (obs_dry + obs_wet) - (bg_dry + bg_wet) AS residual_total FROM (SELECT *, {_OD} AS obs_dry, {_OW} AS obs_wet, {_BD} AS bg_dry, {_BW} AS bg_wet
  FROM lvv QUALIFY row_number() OVER (PARTITION BY profile_no, pressure_hpa ORDER BY valid DESC, line_value DESC, height_m DESC, tax DESC) = 1))"""
DEV, CAL = "1999-01-01", "1999-07-01"
PRED = f"""{OBS},
clim AS (SELECT pressure_hpa, month(time) AS m, avg(residual_dry) AS c_dry, avg(residual_wet) AS c_wet FROM obs WHERE valid AND NOT below_ground AND time < TIMESTAMP '{DEV}' GROUP BY ALL),
clim_level AS (SELECT pressure_hpa, avg(residual_dry) AS l_dry, avg(residual_wet) AS l_wet FROM obs WHERE valid AND NOT below_ground AND time < TIMESTAMP '{DEV}' GROUP BY ALL),
pred AS (SELECT o.*, coalesce(c_dry, l_dry, 0) AS correction_dry, coalesce(c_wet, l_wet, 0) AS correction_wet, coalesce(c_dry, l_dry, 0) + coalesce(c_wet, l_wet, 0) - residual_total AS error,
  coalesce(c_dry, l_dry, 0) + coalesce(c_wet, l_wet, 0) AS correction, CAST(0.5 AS DOUBLE) + tax * 20 AS sd FROM obs o LEFT JOIN clim c ON c.pressure_hpa = o.pressure_hpa AND c.m = month(o.time)
  LEFT JOIN clim_level l ON l.pressure_hpa = o.pressure_hpa WHERE valid AND NOT below_ground)"""


def valid(spark: SparkSession, d: str) -> DataFrame:
    return profiles.valid_level(src.levels(spark, d))


def observed(spark: SparkSession, d: str) -> DataFrame:
    return profiles.residuals(profiles.best_per_level(valid(spark, d), "line_value", "height_m", "tax"))


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """Rows that can be scored, with a climatological correction learnt on the development period, its error and a spread."""
    rows = observed(spark, d).where("valid AND NOT below_ground")
    early = rows.where(F.col("time") < F.lit(DEV).cast("timestamp"))
    month = F.month("time")
    both = early.groupBy("pressure_hpa", month.alias("m")).agg(F.avg("residual_dry").alias("c_dry"), F.avg("residual_wet").alias("c_wet"))  # 72 rows at most
    level = early.groupBy("pressure_hpa").agg(F.avg("residual_dry").alias("l_dry"), F.avg("residual_wet").alias("l_wet"))
    out = rows.withColumn("m", month).join(F.broadcast(both), ["pressure_hpa", "m"], "left").join(F.broadcast(level), "pressure_hpa", "left")
    out = out.withColumn("correction_dry", F.coalesce("c_dry", "l_dry", F.lit(0.0))).withColumn("correction_wet", F.coalesce("c_wet", "l_wet", F.lit(0.0)))
    out = out.withColumn("correction", F.col("correction_dry") + F.col("correction_wet"))
    return out.withColumn("error", F.col("correction") - F.col("residual_total")).withColumn("sd", F.lit(0.5) + F.col("tax") * 20)


@query("PF6", f"WITH {VALID} SELECT pressure_hpa, valid, count(*) AS n FROM lvv GROUP BY ALL")
def level_validity(spark, d):
    return valid(spark, d).groupBy("pressure_hpa", "valid").agg(F.count("*").alias("n"))


@query("PF7", f"WITH {OBS} SELECT profile_no, count(*) AS n_rows, CAST(count(*) FILTER (valid) AS BIGINT) AS n_valid FROM obs GROUP BY 1 HAVING count(*) FILTER (valid) >= 3")
def min_valid_levels(spark, d):
    rows = profiles.min_levels(observed(spark, d), 3)
    return rows.groupBy("profile_no").agg(F.count("*").alias("n_rows"), F.max("n_valid").alias("n_valid"))


@query("PF8", f"""WITH {OBS}, k AS (SELECT profile_no FROM obs WHERE valid AND pressure_hpa IN (1000, 850, 700) GROUP BY 1 HAVING count(*) = 3)
SELECT profile_no, pressure_hpa, round(height_m, 6) AS height_m FROM obs SEMI JOIN k USING (profile_no) WHERE pressure_hpa IN (1000, 850, 700)""")
def complete_profiles(spark, d):
    return profiles.complete(observed(spark, d), (1000, 850, 700)).select("profile_no", "pressure_hpa", r6("height_m", "height_m"))


@query("PF9", f"WITH {OBS} SELECT pressure_hpa, count(*) FILTER (valid AND NOT below_ground AND isfinite(residual_dry) AND isfinite(residual_wet)) AS n_train, count(*) FILTER (valid AND NOT below_ground AND isfinite(residual_total)) AS n_eval FROM obs GROUP BY 1")
def masks(spark, d):
    ok = F.col("valid") & ~F.col("below_ground")
    number = lambda c: metrics.finite(F.col(c)).isNotNull()
    return observed(spark, d).groupBy("pressure_hpa").agg(F.count_if(ok & number("residual_dry") & number("residual_wet")).alias("n_train"), F.count_if(ok & number("residual_total")).alias("n_eval"))


@query("PF12", f"WITH {OBS} SELECT CASE WHEN NOT valid THEN 'missing_observation_level' WHEN below_ground THEN 'below_ground' ELSE 'available' END AS reason, pressure_hpa, count(*) AS n FROM obs GROUP BY ALL")
def mask_reasons(spark, d):
    return observed(spark, d).groupBy(profiles.mask_reason().alias("reason"), "pressure_hpa").agg(F.count("*").alias("n"))


@query("PF14", f"WITH {src.LEVELS_SQL} SELECT pressure_hpa, count(*) FILTER (surface_pressure_pa < pressure_hpa * 100) AS n_below, count(*) AS n FROM lv GROUP BY 1")
def below_ground(spark, d):
    return src.levels(spark, d).groupBy("pressure_hpa").agg(F.count_if(F.col("surface_pressure_pa") < F.col("pressure_hpa") * 100).alias("n_below"), F.count("*").alias("n"))


@query("PF15", f"WITH {src.LEVELS_SQL} SELECT CASE WHEN time < TIMESTAMP '{DEV}' THEN 'development' WHEN time < TIMESTAMP '{CAL}' THEN 'calibration' ELSE 'evaluation' END AS role, count(DISTINCT profile_no) AS profiles, count(DISTINCT station_no) AS stations FROM lv GROUP BY 1")
def temporal_roles(spark, d):
    at = lambda s: F.lit(s).cast("timestamp")
    role = F.when(F.col("time") < at(DEV), "development").when(F.col("time") < at(CAL), "calibration").otherwise("evaluation")
    return src.levels(spark, d).groupBy(role.alias("role")).agg(F.count_distinct("profile_no").alias("profiles"), F.count_distinct("station_no").alias("stations"))


@query("PF18", f"WITH {src.LEVELS_SQL} SELECT hour(time) AS hour, hour(time) IN (0, 12) AS synoptic, least(hour(time) % 12, 12 - hour(time) % 12) <= 1 AS supported, count(*) AS n FROM lv GROUP BY ALL")
def synoptic_hours(spark, d):
    h = F.hour("time")
    off = F.pmod(h, F.lit(12))
    return src.levels(spark, d).groupBy(h.alias("hour"), h.isin(0, 12).alias("synoptic"), (F.least(off, 12 - off) <= 1).alias("supported")).agg(F.count("*").alias("n"))


@query("PF21", f"WITH {src.LEVELS_SQL} SELECT pressure_flag, temperature_flag, CASE WHEN dewpoint_depression_c >= 0 THEN 'dewpoint_depression' WHEN relative_humidity BETWEEN 0 AND 110 THEN 'relative_humidity' ELSE 'missing' END AS source, pressure_flag IN ('A', 'B') AS checked, count(*) AS n FROM lv GROUP BY ALL")
def humidity_sources(spark, d):
    _, source = atmosphere.vapor_pressure(F.col("temperature_k") - 273.15, F.col("dewpoint_depression_c"), F.col("relative_humidity"))
    return src.levels(spark, d).groupBy("pressure_flag", "temperature_flag", source.alias("source"), F.col("pressure_flag").isin("A", "B").alias("checked")).agg(F.count("*").alias("n"))


@query("WN1", f"WITH {OBS} SELECT pressure_hpa, count(*) AS n, count(*) FILTER (valid) AS n_valid, round(sum(line_value), 2) AS line_value FROM obs GROUP BY 1")
def best_rows(spark, d):
    return observed(spark, d).groupBy("pressure_hpa").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), F.round(F.sum("line_value"), 2).alias("line_value"))


@query("WN2", f"""WITH {OBS}, k AS (SELECT DISTINCT profile_no FROM obs), l AS (SELECT unnest([1000, 925, 850, 700, 500, 300]) AS pressure_hpa)
SELECT profile_no, pressure_hpa, coalesce(valid, false) AS valid, round(temperature_k, 6) AS temperature_k FROM k CROSS JOIN l LEFT JOIN obs USING (profile_no, pressure_hpa)""")
def all_levels(spark, d):
    return profiles.dense(observed(spark, d)).select("profile_no", "pressure_hpa", "valid", r6("temperature_k", "temperature_k"))


@query("WN10", f"WITH {OBS} SELECT station_no, round(avg(abs(residual_total - m)), 6) AS spread FROM (SELECT station_no, residual_total, avg(residual_total) OVER (PARTITION BY station_no, month(time)) AS m FROM obs) GROUP BY 1")
def group_means(spark, d):
    mean = F.avg("residual_total").over(Window.partitionBy("station_no", F.month("time")))
    rows = observed(spark, d).select("station_no", F.abs(F.col("residual_total") - mean).alias("x"))
    return rows.groupBy("station_no").agg(r6(F.avg("x"), "spread"))


@query("WN11", f"""WITH {OBS}, s AS (SELECT profile_no, pressure_hpa, lead(pressure_hpa) OVER w AS above, (lead(height_m) OVER w - height_m) / 1000 AS dz, lead(obs_total) OVER w - obs_total AS dv
  FROM obs WHERE valid WINDOW w AS (PARTITION BY profile_no ORDER BY pressure_hpa DESC))
SELECT pressure_hpa || '-' || above AS pair, count(*) AS n, round(avg(dv / dz), 6) AS gradient FROM s
WHERE list_position([1000, 925, 850, 700, 500, 300], above) - list_position([1000, 925, 850, 700, 500, 300], pressure_hpa) = 1 AND dz > 0 GROUP BY 1""")
def level_gradients(spark, d):
    return profiles.gradients(observed(spark, d), "obs_total").groupBy("pair").agg(F.count("*").alias("n"), r6(F.avg("gradient"), "gradient"))


@query("WN12", f"""WITH {OBS}, s AS (SELECT profile_no, -ln(pressure_hpa) AS x, obs_total AS y, lead(-ln(pressure_hpa)) OVER w AS x2, lead(obs_total) OVER w AS y2 FROM obs WHERE valid WINDOW w AS (PARTITION BY profile_no ORDER BY pressure_hpa DESC))
SELECT profile_no, count(*) + 1 AS n_levels, round(sum((x2 - x) * (y + y2) / 2), 6) AS integral FROM s WHERE x2 IS NOT NULL GROUP BY 1 HAVING count(*) >= 2""")
def level_integrals(spark, d):
    return profiles.integral(observed(spark, d), "obs_total").select("profile_no", "n_levels", r6("integral", "integral"))


@query("JN9", f"""WITH {OBS}, s AS (SELECT profile_no, height_m AS x, obs_total AS y, lead(height_m) OVER w AS x2, lead(obs_total) OVER w AS y2, max(height_m) OVER (PARTITION BY profile_no) AS top FROM obs WHERE valid WINDOW w AS (PARTITION BY profile_no ORDER BY height_m, pressure_hpa DESC)),
h AS (SELECT CAST(unnest(range(500, 9001, 500)) AS DOUBLE) AS height)
SELECT profile_no, height, round(y + (height - x) / (x2 - x) * (y2 - y), 6) AS value FROM s JOIN h ON height >= x AND (height < x2 OR (height = top AND x2 = top)) WHERE x2 > x""")
def height_join(spark, d):
    return profiles.at_heights(observed(spark, d), "obs_total", list(range(500, 9001, 500))).select("profile_no", "height", r6("value", "value"))


@query("SF1", f"WITH {src.LEVELS_SQL} SELECT pressure_hpa, round(avg({_ES.format('temperature_k - CAST(273.15 AS DOUBLE)')}), 6) AS es FROM lv GROUP BY 1")
def saturation(spark, d):
    return src.levels(spark, d).groupBy("pressure_hpa").agg(r6(F.avg(atmosphere.saturation_pressure(F.col("temperature_k") - 273.15)), "es"))


@query("SF3", f"""WITH {src.LEVELS_SQL}, e AS (SELECT pressure_hpa, CASE WHEN dewpoint_depression_c >= 0 THEN {_ES.format('temperature_k - CAST(273.15 AS DOUBLE) - dewpoint_depression_c')}
  WHEN relative_humidity BETWEEN 0 AND 110 THEN relative_humidity / 100 * {_ES.format('temperature_k - CAST(273.15 AS DOUBLE)')} END AS e FROM lv)
SELECT pressure_hpa, count(e) AS n, round(avg(CASE WHEN pressure_hpa - CAST(0.378 AS DOUBLE) * e > 0 AND e >= 0 THEN CAST(0.622 AS DOUBLE) * e / (pressure_hpa - CAST(0.378 AS DOUBLE) * e) END), 9) AS q FROM e GROUP BY 1""")
def humidity(spark, d):
    e, _ = atmosphere.vapor_pressure(F.col("temperature_k") - 273.15, F.col("dewpoint_depression_c"), F.col("relative_humidity"))
    rows = src.levels(spark, d).withColumn("e", e)
    return rows.groupBy("pressure_hpa").agg(F.count("e").alias("n"), F.round(F.avg(atmosphere.specific_humidity(F.col("e"), F.col("pressure_hpa"))), 9).alias("q"))


@query("SF4", f"WITH {OBS} SELECT profile_no, pressure_hpa, round(obs_dry, 6) AS dry, round(obs_wet, 6) AS wet, round(obs_total, 6) AS total FROM obs")
def refractivity(spark, d):
    return observed(spark, d).select("profile_no", "pressure_hpa", r6("obs_dry", "dry"), r6("obs_wet", "wet"), r6("obs_total", "total"))


@query("SF6", f"WITH {src.LEVELS_SQL} SELECT pressure_hpa, round(avg(height_m * CAST(9.80665 AS DOUBLE) / CAST(9.80665 AS DOUBLE)), 6) AS height, round(avg(6371000 * height_m / (6371000 - height_m)), 6) AS geometric, round(avg(44330 * (1 - pow(pressure_hpa / CAST(1013.25 AS DOUBLE), CAST(0.1903 AS DOUBLE)))), 6) AS standard, round(avg(obs + CAST(0.157 AS DOUBLE) * height_m), 6) AS modified FROM (SELECT *, {_OD} + {_OW} AS obs FROM lv) GROUP BY 1")
def heights(spark, d):
    h, p = F.col("height_m"), F.col("pressure_hpa")
    n = atmosphere.refractivity(F.col("temperature_k"), F.col("q"), p)[2]
    return src.levels(spark, d).groupBy("pressure_hpa").agg(
        r6(F.avg(atmosphere.geopotential_height(h * 9.80665)), "height"), r6(F.avg(atmosphere.geometric_height(h)), "geometric"), r6(F.avg(atmosphere.standard_height(p)), "standard"), r6(F.avg(atmosphere.modified_refractivity(n, h)), "modified")
    )


def _total(t: str, q: str) -> str:
    a, b = _n(t, q)
    return f"({a} + {b})"


_OO, _OB, _BO, _BB = _total("temperature_k", "q"), _total("temperature_k", "bg_q"), _total("bg_temperature_k", "q"), _total("bg_temperature_k", "bg_q")


@query("SF14", f"WITH {OBS} SELECT pressure_hpa, round(avg((({_OB} - {_BB}) + ({_OO} - {_BO})) / 2), 6) AS by_temperature, round(avg((({_BO} - {_BB}) + ({_OO} - {_OB})) / 2), 6) AS by_humidity, round(avg(residual_total), 6) AS residual FROM obs GROUP BY 1")
def shares(spark, d):
    by_t, by_q = atmosphere.attribution(F.col("temperature_k"), F.col("q"), F.col("bg_temperature_k"), F.col("bg_q"), F.col("pressure_hpa"))
    return observed(spark, d).groupBy("pressure_hpa").agg(r6(F.avg(by_t), "by_temperature"), r6(F.avg(by_q), "by_humidity"), r6(F.avg("residual_total"), "residual"))


_Z = "(error / sd)"


@query("SF16", f"WITH {PRED} SELECT pressure_hpa, round(avg({scores.normal_cdf_sql(_Z)}), 6) AS pit_mean, round(var_pop({scores.normal_cdf_sql(_Z)}), 6) AS pit_variance FROM pred GROUP BY 1")
def pit(spark, d):
    p = scores.normal_cdf(F.col("error") / F.col("sd"))
    return predicted(spark, d).groupBy("pressure_hpa").agg(r6(F.avg(p), "pit_mean"), r6(F.var_pop(p), "pit_variance"))


_SEASON = "list_extract(['DJF', 'MAM', 'JJA', 'SON'], CAST(floor(month(time) % 12 / 3) AS INT) + 1)"


@query("SF22", f"""WITH {OBS} SELECT {_SEASON} AS season, CASE WHEN latitude >= 30 THEN 'north' WHEN latitude <= -30 THEN 'south' ELSE 'tropics' END AS region,
  CASE WHEN abs(latitude) < 23.5 THEN 'tropics' WHEN abs(latitude) < 35 THEN 'subtropics' WHEN abs(latitude) < 60 THEN 'midlatitudes' ELSE 'polar' END AS band, count(*) AS n FROM obs GROUP BY ALL""")
def regions(spark, d):
    return observed(spark, d).groupBy(geo.season(F.col("time")).alias("season"), geo.region(F.col("latitude")).alias("region"), geo.latitude_band(F.col("latitude")).alias("band")).agg(F.count("*").alias("n"))


@query("SF23", f"""WITH {src.LEVELS_SQL} SELECT CASE WHEN elevation_m >= 0 AND elevation_m <= 500 THEN 'low' WHEN elevation_m > 500 AND elevation_m <= 1500 THEN 'middle' WHEN elevation_m > 1500 AND elevation_m <= 4000 THEN 'high' END AS elevation,
  CASE WHEN height_m >= 0 AND height_m < 2000 THEN '0-2' WHEN height_m >= 2000 AND height_m < 5000 THEN '2-5' WHEN height_m >= 5000 AND height_m < 20000 THEN '5+' END AS band, count(*) AS n FROM lv GROUP BY ALL""")
def bins(spark, d):
    e = geo.binned(F.col("elevation_m"), [0, 500, 1500, 4000], ["low", "middle", "high"])
    h = geo.binned(F.col("height_m"), [0, 2000, 5000, 20000], ["0-2", "2-5", "5+"], right_closed=False)
    return src.levels(spark, d).groupBy(e.alias("elevation"), h.alias("band")).agg(F.count("*").alias("n"))


@query("SF24", f"WITH {src.STATIONS_SQL} SELECT 'lat' || CAST(least(greatest(floor((latitude + 90) / 30), 0), 5) AS INT) || '_lon' || CAST(least(floor(((longitude % 360 + 360) % 360) / 60), 5) AS INT) AS block, count(*) AS n FROM stations GROUP BY 1")
def blocks(spark, d):
    return src.stations(spark, d).groupBy(geo.block(F.col("latitude"), F.col("longitude")).alias("block")).agg(F.count("*").alias("n"))


_POINT = "count({0}) AS n, round(sqrt(avg({0} * {0})), 6) AS rmse, round(avg(abs({0})), 6) AS mae, round(avg({0}), 6) AS bias"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(c, c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


@query("AG1", f"WITH {PRED} SELECT pressure_hpa, {_POINT.format('error')} FROM pred GROUP BY 1")
def point_metrics(spark, d):
    return _rounded(predicted(spark, d).groupBy("pressure_hpa").agg(*metrics.point(F.col("error"))))


@query("AG2", f"""WITH {PRED}, g AS (SELECT error, CAST(pressure_hpa AS VARCHAR) AS level, {_SEASON} AS season, CASE WHEN latitude >= 30 THEN 'north' WHEN latitude <= -30 THEN 'south' ELSE 'tropics' END AS region, CAST(month(time) AS VARCHAR) AS month FROM pred)
SELECT CASE WHEN grouping(level) = 0 THEN 'level' WHEN grouping(season) = 0 THEN 'season' WHEN grouping(region) = 0 THEN 'region' WHEN grouping(month) = 0 THEN 'month' ELSE 'overall' END AS grouping,
  coalesce(level, season, region, month, 'all') AS "group", {_POINT.format('error')} FROM g GROUP BY GROUPING SETS ((level), (season), (region), (month), ())""")
def grouped_metrics(spark, d):
    rows = predicted(spark, d).select("error", "pressure_hpa", geo.season(F.col("time")).alias("season"), geo.region(F.col("latitude")).alias("region"), F.month("time").alias("month"))
    return _rounded(metrics.grouped(rows, "error", {"level": "pressure_hpa", "season": "season", "region": "region", "month": "month"}))


_DE, _WE = "(correction_dry - residual_dry)", "(correction_wet - residual_wet)"


@query("AG7", f"""WITH {PRED} SELECT pressure_hpa, round(avg({_DE} * {_DE}), 6) AS mse_dry, round(avg({_WE} * {_WE}), 6) AS mse_wet, round(2 * avg({_DE} * {_WE}), 6) AS "cross", round(avg(({_DE} + {_WE}) * ({_DE} + {_WE})), 6) AS mse_total,
  round(pow(avg({_DE} + {_WE}), 2), 6) AS bias2, round(var_pop({_DE} + {_WE}), 6) AS variance, round(2 * covar_pop({_DE}, {_WE}), 6) AS covariance2, round(2 * avg({_DE}) * avg({_WE}), 6) AS bias_product2 FROM pred GROUP BY 1""")
def error_budget(spark, d):
    dry, wet = F.col("correction_dry") - F.col("residual_dry"), F.col("correction_wet") - F.col("residual_wet")
    return _rounded(predicted(spark, d).groupBy("pressure_hpa").agg(*metrics.budget(dry, wet)))


@query("AG9", f"""WITH {PRED} SELECT pressure_hpa, round(avg(correction * correction), 6) AS penalty, round(2 * avg(residual_total * correction), 6) AS alignment, round(avg(error * error) - avg(residual_total * residual_total), 6) AS delta_mse,
  round(pow(avg(error), 2) - pow(avg(residual_total), 2), 6) AS delta_bias2, round(var_pop(error) - var_pop(residual_total), 6) AS delta_variance FROM pred GROUP BY 1""")
def correction_parts(spark, d):
    return _rounded(predicted(spark, d).groupBy("pressure_hpa").agg(*metrics.correction(F.col("residual_total"), F.col("correction"))))


_HALF = f"(sd * CAST({scores.QUANTILES[0.9]!r} AS DOUBLE))"


@query("AG11", f"""WITH {PRED} SELECT pressure_hpa, round(avg({_Z} * {_Z} / 2 + ln(sd) + {math.log(2 * math.pi) / 2!r}), 6) AS nll, round(avg({scores.crps_sql('error', 'sd')}), 6) AS crps,
  round(avg(2 * {_HALF} + 2 / (1 - CAST(0.9 AS DOUBLE)) * greatest(abs(error) - {_HALF}, 0)), 6) AS interval_score_90, round(avg(2 * {_HALF}), 6) AS width_90,
  {", ".join(f"round(avg(CASE WHEN abs(error) <= sd * CAST({z!r} AS DOUBLE) THEN 1.0 ELSE 0.0 END), 6) AS coverage_{int(level * 100)}" for level, z in scores.QUANTILES.items())} FROM pred GROUP BY 1""")
def gaussian_scores(spark, d):
    return _rounded(predicted(spark, d).groupBy("pressure_hpa").agg(*metrics.gaussian(F.col("error"), F.col("sd"))))


@query("AG14", f"""WITH {PRED}, b AS (SELECT CAST(least(floor({scores.normal_cdf_sql(_Z)} * 20), 19) AS BIGINT) AS bin FROM pred) SELECT r AS bin, count(b.bin) AS n FROM range(20) t(r) LEFT JOIN b ON b.bin = r GROUP BY 1""")
def pit_histogram(spark, d):
    return metrics.calibration(predicted(spark, d), F.col("error") / F.col("sd"))


@query("AG15", f"WITH {PRED}, q AS (SELECT quantile_cont({_Z}, list_transform(range(1, 200), lambda i: i / 200)) AS v FROM pred) SELECT CAST(unnest(range(1, 200)) AS INT) AS k, round(unnest(v), 6) AS z FROM q")
def qq(spark, d):
    """All 199 ranks come from the same histograms."""
    q = quantiles.quantiles(predicted(spark, d), F.col("error") / F.col("sd"), [], [i / 200 for i in range(1, 200)])
    return q.select((F.col("k") + 1).alias("k"), r6("q", "z"))


@query("AG16", f"WITH {OBS} SELECT pressure_hpa, month(time) AS month, hour(time) AS hour, count(*) AS n, round(avg(residual_total), 6) AS residual FROM obs WHERE valid AND NOT below_ground GROUP BY ALL")
def climatology(spark, d):
    rows = observed(spark, d).where("valid AND NOT below_ground")
    return rows.groupBy("pressure_hpa", F.month("time").alias("month"), F.hour("time").alias("hour")).agg(F.count("*").alias("n"), r6(F.avg("residual_total"), "residual"))


@query("AG17", f"WITH {PRED} SELECT station_no, count(*) AS n, round(sqrt(avg(error * error)) - sqrt(avg(residual_total * residual_total)), 6) AS delta_rmse FROM pred GROUP BY 1")
def paired_rmse(spark, d):
    e, r = F.col("error"), F.col("residual_total")
    return predicted(spark, d).groupBy("station_no").agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(e * e)) - F.sqrt(F.avg(r * r)), "delta_rmse"))


@query("AG18", f"""WITH {PRED}, m AS (SELECT station_no, strftime(time, '%Y-%m') AS month, sqrt(avg(error * error)) - sqrt(avg(residual_total * residual_total)) AS x FROM pred GROUP BY ALL),
s AS (SELECT station_no, avg(x) AS x FROM m GROUP BY 1) SELECT count(*) AS n_stations, round(avg(x), 6) AS mean_delta FROM s""")
def monthly_means(spark, d):
    e, r = F.col("error"), F.col("residual_total")
    m = predicted(spark, d).groupBy("station_no", F.date_format("time", "yyyy-MM").alias("month")).agg((F.sqrt(F.avg(e * e)) - F.sqrt(F.avg(r * r))).alias("x"))
    return m.groupBy("station_no").agg(F.avg("x").alias("x")).agg(F.count("*").alias("n_stations"), r6(F.avg("x"), "mean_delta"))


@query("AG19", f"WITH {OBS} SELECT pressure_hpa, round(var_samp(residual_total), 6) AS total, round(var_samp(residual_dry), 6) AS dry, round(var_samp(residual_wet), 6) AS wet, round(2 * covar_samp(residual_dry, residual_wet), 6) AS covariance2 FROM obs GROUP BY 1")
def variances(spark, d):
    return observed(spark, d).groupBy("pressure_hpa").agg(r6(F.var_samp("residual_total"), "total"), r6(F.var_samp("residual_dry"), "dry"), r6(F.var_samp("residual_wet"), "wet"), r6(2 * F.covar_samp("residual_dry", "residual_wet"), "covariance2"))


@query("AG24", f"""WITH {OBS}, v AS (SELECT profile_no, pressure_hpa, residual_total AS r FROM obs WHERE valid)
SELECT a.pressure_hpa AS level_a, b.pressure_hpa AS level_b, count(*) AS n, round(CASE WHEN count(*) < 30 THEN 0 ELSE corr(a.r, b.r) END, 6) AS r FROM v a JOIN v b ON a.profile_no = b.profile_no AND a.pressure_hpa >= b.pressure_hpa GROUP BY ALL""")
def level_correlation(spark, d):
    """A profile's levels stand side by side in one row, so the 21 pairs come from one aggregation without a join."""
    wide = side_by_side(observed(spark, d).where("valid"), "residual_total")

    def pair(a: int, b: int) -> Column:
        x, y = F.col(f"x{a}"), F.col(f"x{b}")
        return F.struct(F.lit(a).alias("level_a"), F.lit(b).alias("level_b"), F.count(x + y).alias("n"), F.corr(x, y).alias("r"))

    pairs = wide.agg(F.array(*(pair(a, b) for a in src.LEVELS for b in src.LEVELS if a >= b)).alias("pairs")).select(F.inline("pairs")).where("n > 0")
    return pairs.select("level_a", "level_b", "n", r6(F.when(F.col("n") < 30, 0.0).otherwise(F.col("r")), "r"))


def side_by_side(rows: DataFrame, value: str) -> DataFrame:
    """profile_no, x1000 to x300 of rows with one row a level."""
    return rows.groupBy("profile_no").agg(*(F.max(F.when(F.col("pressure_hpa") == p, F.col(value))).alias(f"x{p}") for p in src.LEVELS))


@query("AG25", f"WITH {PRED} SELECT pressure_hpa, round(greatest(quantile_cont(abs(error) / sd, 0.9) / CAST({scores.QUANTILES[0.9]!r} AS DOUBLE), CAST(1e-6 AS DOUBLE)), 6) AS scale FROM pred WHERE time >= TIMESTAMP '{DEV}' AND time < TIMESTAMP '{CAL}' GROUP BY 1")
def calibration_scale(spark, d):
    some = predicted(spark, d).where(F.col("time").between(F.lit(DEV).cast("timestamp"), F.lit(CAL).cast("timestamp")) & (F.col("time") < F.lit(CAL).cast("timestamp")))
    q = quantiles.quantiles(some, F.abs(F.col("error")) / F.col("sd"), ["pressure_hpa"], [0.9])
    return q.select("pressure_hpa", r6(F.greatest(F.col("q") / scores.QUANTILES[0.9], F.lit(1e-6)), "scale"))


@query("AG26", f"""WITH {PRED} SELECT CASE WHEN grouping(pressure_hpa) = 0 THEN CAST(pressure_hpa AS VARCHAR) ELSE 'pooled' END AS level, round(greatest(sqrt(avg(error * error)), CAST(1e-3 AS DOUBLE)), 6) AS scale FROM pred GROUP BY GROUPING SETS ((pressure_hpa), ())""")
def rms_scales(spark, d):
    e = F.col("error")
    out = predicted(spark, d).rollup("pressure_hpa").agg(F.grouping("pressure_hpa").alias("g"), F.greatest(F.sqrt(F.avg(e * e)), F.lit(1e-3)).alias("s"))
    return out.select(F.when(F.col("g") == 1, "pooled").otherwise(F.col("pressure_hpa").cast("string")).alias("level"), r6("s", "scale"))


@query("AG27", f"WITH {OBS} SELECT pressure_hpa, round(quantile_cont(residual_total, 0.01), 6) AS low, round(quantile_cont(residual_total, 0.99), 6) AS high FROM obs WHERE valid GROUP BY 1")
def clip_bounds(spark, d):
    q = quantiles.quantiles(observed(spark, d).where("valid"), F.col("residual_total"), ["pressure_hpa"], [0.01, 0.99])
    return q.groupBy("pressure_hpa").agg(*(r6(F.max(F.when(F.col("k") == k, F.col("q"))), c) for k, c in enumerate(("low", "high"))))


@query("AG23", f"WITH {OBS} SELECT round(quantile_cont(obs_wet, 0), 6) AS e0, round(quantile_cont(obs_wet, 0.25), 6) AS e1, round(quantile_cont(obs_wet, 0.5), 6) AS e2, round(quantile_cont(obs_wet, 0.75), 6) AS e3, round(quantile_cont(obs_wet, 1), 6) AS e4 FROM obs WHERE valid AND time < TIMESTAMP '{DEV}'")
def wet_edges(spark, d):
    some = observed(spark, d).where(F.col("valid") & (F.col("time") < F.lit(DEV).cast("timestamp")))
    q = quantiles.quantiles(some, F.col("obs_wet"), [], [k / 4 for k in range(5)])
    return q.agg(*(r6(F.max(F.when(F.col("k") == k, F.col("q"))), f"e{k}") for k in range(5)))


@query("AG29", f"""WITH {PRED}, c AS (SELECT pressure_hpa, station_no, count(*) AS n, sum(error) AS s, sum(error * error) AS ss FROM pred GROUP BY ALL)
SELECT pressure_hpa, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS n, round(sqrt(sum(ss) / sum(n)), 6) AS rmse, round(sum(s) / sum(n), 6) AS bias, round(sum(ss) / sum(n) - pow(sum(s) / sum(n), 2), 6) AS variance FROM c GROUP BY 1""")
def cluster_sums(spark, d):
    e = F.col("error")
    c = predicted(spark, d).groupBy("pressure_hpa", "station_no").agg(F.count("*").alias("n"), F.sum(e).alias("s"), F.sum(e * e).alias("ss"))
    n, s, ss = F.sum("n"), F.sum("s"), F.sum("ss")
    return c.groupBy("pressure_hpa").agg(F.count("*").alias("clusters"), n.alias("n"), r6(F.sqrt(ss / n), "rmse"), r6(s / n, "bias"), r6(ss / n - F.pow(s / n, F.lit(2)), "variance"))


@query("AG40", f"""WITH {OBS}, k AS (SELECT profile_no, string_agg(CAST(pressure_hpa AS VARCHAR), '-' ORDER BY pressure_hpa DESC) AS levels FROM obs WHERE valid GROUP BY 1 HAVING count(*) = 3) SELECT levels, count(*) AS n FROM k GROUP BY 1""")
def three_levels(spark, d):
    k = observed(spark, d).where("valid").groupBy("profile_no").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("pressure_hpa"), asc=False), lambda p: p.cast("string")), "-").alias("levels"))
    return k.where("n = 3").groupBy("levels").agg(F.count("*").alias("n"))


@query("AG35", f"WITH {OBS} SELECT station_no, min(time) AS first_time, max(time) AS last_time, count(*) FILTER (valid) AS n_valid, count(DISTINCT profile_no) AS profiles, round(min(elevation_m), 6) AS elevation_m FROM obs GROUP BY 1")
def station_attributes(spark, d):
    out = observed(spark, d).groupBy("station_no").agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.count_if("valid").alias("n_valid"), F.count_distinct("profile_no").alias("profiles"), r6(F.min("elevation_m"), "elevation_m"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_time", "last_time")})


@query("AR1", f"""WITH {OBS} SELECT profile_no, {", ".join(f"round(max(CASE WHEN pressure_hpa = {p} THEN obs_total END), 6) AS n_{p}" for p in src.LEVELS)} FROM obs GROUP BY 1""")
def profile_arrays(spark, d):
    rows = profiles.arrays(observed(spark, d), "obs_total")
    return rows.select("profile_no", *(r6(F.col("obs_total")[i], f"n_{p}") for i, p in enumerate(src.LEVELS)))


@query("AR2", f"""WITH {OBS} SELECT profile_no, CAST(sum(CASE WHEN NOT valid THEN 0 ELSE {_case} END) AS BIGINT) AS mask_bits FROM obs GROUP BY 1""" if (_case := "CASE pressure_hpa " + " ".join(f"WHEN {p} THEN {1 << i}" for i, p in enumerate(src.LEVELS)) + " END") else "")
def bits(spark, d):
    return profiles.mask_bits(observed(spark, d))


@query("DQ4", f"WITH {OBS} SELECT max(abs(obs_total - obs_dry - obs_wet)) <= 1e-9 AS closed, count(*) AS n FROM obs")
def component_identity(spark, d):
    return observed(spark, d).agg((F.max(F.abs(F.col("obs_total") - F.col("obs_dry") - F.col("obs_wet"))) <= 1e-9).alias("closed"), F.count("*").alias("n"))


@query("DQ5", f"WITH {OBS}, k AS (SELECT profile_no, count(DISTINCT pressure_hpa) AS n FROM obs WHERE valid GROUP BY 1) SELECT n AS n_levels, count(*) AS profiles FROM k GROUP BY 1")
def level_sets(spark, d):
    k = observed(spark, d).where("valid").groupBy("profile_no").agg(F.count_distinct("pressure_hpa").alias("n_levels"))
    return k.groupBy("n_levels").agg(F.count("*").alias("profiles"))


@query("DQ2", f"""WITH {OBS}, p AS (SELECT strftime(time, '%Y-%m') AS month, profile_no, count(*) AS n, count(*) FILTER (valid) AS v FROM obs GROUP BY ALL), m AS (SELECT month, count(*) AS profiles, min(v) AS least_valid, max(n) AS most_levels FROM p GROUP BY 1),
r AS (SELECT strftime(time, '%Y-%m') AS month, count(*) AS n_rows, count(*) FILTER (hour(time) NOT IN (0, 12)) AS off_hours, count(*) FILTER (NOT isfinite(residual_total)) AS not_finite, count(*) FILTER (abs(obs_total - obs_dry - obs_wet) > 1e-9) AS open_sums FROM obs GROUP BY 1)
SELECT month, profiles, n_rows, least_valid, most_levels, off_hours, not_finite, open_sums, most_levels <= 6 AND off_hours = 0 AND not_finite = 0 AND open_sums = 0 AS passed FROM r JOIN m USING (month)""")
def monthly_audit(spark, d):
    rows = observed(spark, d).withColumn("month", F.date_format("time", "yyyy-MM"))
    p = rows.groupBy("month", "profile_no").agg(F.count("*").alias("n"), F.count_if("valid").alias("v"))
    m = p.groupBy("month").agg(F.count("*").alias("profiles"), F.min("v").alias("least_valid"), F.max("n").alias("most_levels"))
    r = rows.groupBy("month").agg(
        F.count("*").alias("n_rows"), F.count_if(~F.hour("time").isin(0, 12)).alias("off_hours"), F.count_if(metrics.finite(F.col("residual_total")).isNull()).alias("not_finite"), F.count_if(F.abs(F.col("obs_total") - F.col("obs_dry") - F.col("obs_wet")) > 1e-9).alias("open_sums")
    )
    return r.join(m, "month").withColumn("passed", F.expr("most_levels <= 6 AND off_hours = 0 AND not_finite = 0 AND open_sums = 0"))


@query("SO3", f"WITH {src.LEVELS_SQL} SELECT profile_no, pressure_hpa, count(*) AS n FROM lv GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark, d):
    return src.levels(spark, d).groupBy("profile_no", "pressure_hpa").agg(F.count("*").alias("n")).where("n > 1")


@query("SO6", f"""WITH {OBS} SELECT profile_no, {", ".join(f"round(max(CASE WHEN pressure_hpa = {p} THEN temperature_k END), 6) AS t_{p}" for p in src.LEVELS)} FROM obs WHERE valid GROUP BY 1""")
def wide(spark, d):
    out = observed(spark, d).where("valid").groupBy("profile_no").pivot("pressure_hpa", list(src.LEVELS)).agg(F.max("temperature_k"))
    return out.select("profile_no", *(r6(F.col(str(p)), f"t_{p}") for p in src.LEVELS))


@query("SL2", f"WITH {OBS} SELECT profile_no, pressure_hpa FROM (SELECT *, dense_rank() OVER (ORDER BY station_no, time, profile_no) AS k FROM (SELECT DISTINCT station_no, time, profile_no FROM obs) QUALIFY k <= 500) JOIN obs USING (station_no, time, profile_no)")
def first_profiles(spark, d):
    """A top-k report: the limit is what the operator is for."""
    rows = observed(spark, d)
    keys = ["station_no", "time", "profile_no"]
    first = rows.select(*keys).distinct().orderBy(*keys).limit(500)
    return rows.join(F.broadcast(first), keys, "left_semi").select("profile_no", "pressure_hpa")


@query("JN18", f"""WITH {OBS}, c AS (SELECT station_no, month(time) AS m, pressure_hpa, year(time) AS y, avg(residual_total) AS r FROM obs WHERE valid AND year(time) IN (1996, 1997) GROUP BY ALL),
a AS (SELECT * FROM c WHERE y = 1996), b AS (SELECT * FROM c WHERE y = 1997)
SELECT coalesce(a.station_no, b.station_no) AS station_no, coalesce(a.m, b.m) AS month, coalesce(a.pressure_hpa, b.pressure_hpa) AS pressure_hpa, a.r IS NOT NULL AND b.r IS NOT NULL AS matched, round(b.r - a.r, 6) AS change
FROM a FULL JOIN b ON a.station_no = b.station_no AND a.m = b.m AND a.pressure_hpa = b.pressure_hpa""")
def matched_cells(spark, d):
    cells = observed(spark, d).where("valid").groupBy("station_no", F.month("time").alias("month"), "pressure_hpa", F.year("time").alias("y")).agg(F.avg("residual_total").alias("r"))
    a, b = (cells.where(F.col("y") == y).drop("y").withColumnRenamed("r", name) for y, name in ((1996, "a"), (1997, "b")))
    return a.join(b, ["station_no", "month", "pressure_hpa"], "full").select("station_no", "month", "pressure_hpa", (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"), r6(F.col("b") - F.col("a"), "change"))


@query("JN22", f"""WITH {PRED}, c AS (SELECT station_no, count(*) AS n, sum(error * error) AS ss FROM pred GROUP BY 1) SELECT station_no, round(sqrt((sum(ss) OVER () - ss) / (sum(n) OVER () - n)), 6) AS rmse_without FROM c""")
def leave_one_out(spark, d):
    e = F.col("error")
    c = predicted(spark, d).groupBy("station_no").agg(F.count("*").alias("n"), F.sum(e * e).alias("ss"))
    whole = c.agg(F.sum("n").alias("all_n"), F.sum("ss").alias("all_ss"))
    return c.crossJoin(F.broadcast(whole)).select("station_no", r6(F.sqrt((F.col("all_ss") - F.col("ss")) / (F.col("all_n") - F.col("n"))), "rmse_without"))


_DRAW = "CAST('0x' || substr(md5('17:' || b || ':' || s), 1, 8) AS BIGINT)"


@query("RS4", f"""WITH {src.STATIONS_SQL}, r AS (SELECT station_no, row_number() OVER (ORDER BY md5('42:' || station_no), station_no) - 1 AS i, count(*) OVER () AS n FROM stations)
SELECT station_no, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.7) + floor(n * 0.1) THEN 'calibration' ELSE 'test' END AS role FROM r""")
def station_split(spark, d):
    return resampling.split(src.stations(spark, d), "station_no", 42).select("station_no", "role")


@query("RS5", f"WITH {src.STATIONS_SQL} SELECT station_no, CAST((row_number() OVER (ORDER BY md5('11:' || station_no), station_no) - 1) % 5 AS INT) AS fold FROM stations")
def station_folds(spark, d):
    return resampling.folds(src.stations(spark, d), "station_no", 11, 5).select("station_no", F.col("fold").cast("int").alias("fold"))
