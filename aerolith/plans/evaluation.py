"""Queries that score, audit and compare predictions, keyed by operator, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from aerolith.functions import geo, scores
from aerolith.operators import checks, metrics, quantiles, resampling
from aerolith.plans.formulas import LEVEL
from aerolith.plans.soundings import _SEASON, CAL, DEV, OBS, PRED, observed, predicted, r6, side_by_side
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


def _at(text: str):
    return F.lit(text).cast("timestamp")


_BAND = "CASE WHEN abs(latitude) < 23.5 THEN 'tropics' WHEN abs(latitude) < 35 THEN 'subtropics' WHEN abs(latitude) < 60 THEN 'midlatitudes' ELSE 'polar' END"


@query("AG5", f"""WITH {PRED}, p AS (SELECT *, {_BAND} AS band, CASE WHEN time < TIMESTAMP '{DEV}' THEN 'development' WHEN time < TIMESTAMP '{CAL}' THEN 'calibration' ELSE 'evaluation' END AS role FROM pred)
SELECT role, coalesce(CAST(pressure_hpa AS VARCHAR), 'all') AS level, coalesce(band, 'all') AS band, count(*) AS n, round(sqrt(avg(error * error)), 6) AS rmse, round(sqrt(avg(residual_total * residual_total)), 6) AS background_rmse FROM p GROUP BY GROUPING SETS ((role, pressure_hpa), (role, band), (role))""")
def evaluation(spark, d):
    role = F.when(F.col("time") < _at(DEV), "development").when(F.col("time") < _at(CAL), "calibration").otherwise("evaluation")
    rows = predicted(spark, d).select("error", "residual_total", F.col("pressure_hpa").cast("string").alias("level"), geo.latitude_band(F.col("latitude")).alias("band"), role.alias("role"))
    rmse = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    c = [F.col(x) for x in ("role", "level", "band")]
    out = rows.groupingSets([[c[0], c[1]], [c[0], c[2]], [c[0]]], *c).agg(F.count("*").alias("n"), r6(rmse("error"), "rmse"), r6(rmse("residual_total"), "background_rmse"))
    return out.fillna("all", ["level", "band"])


@query("AG6", f"WITH {PRED} SELECT station_no, count(*) AS n, round(sqrt(avg(error * error)), 6) AS rmse, round(avg(error), 6) AS bias, CASE WHEN count(*) > 1 THEN round(1 - sum(error * error) / (count(*) * var_pop(residual_total)), 6) END AS r2 FROM pred GROUP BY 1")
def station_r2(spark, d):
    e, n = F.col("error"), F.count("*")
    r2 = F.when(n > 1, 1 - F.sum(e * e) / (n * F.var_pop("residual_total")))
    return predicted(spark, d).groupBy("station_no").agg(n.alias("n"), r6(F.sqrt(F.avg(e * e)), "rmse"), r6(F.avg(e), "bias"), r6(r2, "r2"))


@query("AG8", f"""WITH {PRED} SELECT pressure_hpa, round(avg(error * error) - avg(residual_total * residual_total), 6) AS mse_total, round(avg(pow(correction_dry - residual_dry, 2)) - avg(pow(residual_dry, 2)), 6) AS mse_dry,
  round(avg(pow(correction_wet - residual_wet, 2)) - avg(pow(residual_wet, 2)), 6) AS mse_wet, round(2 * (avg((correction_dry - residual_dry) * (correction_wet - residual_wet)) - avg(residual_dry * residual_wet)), 6) AS cross_term FROM pred GROUP BY 1""")
def budget_change(spark, d):
    dry, wet = F.col("correction_dry") - F.col("residual_dry"), F.col("correction_wet") - F.col("residual_wet")
    model, base = metrics.budget(dry, wet), metrics.budget(-F.col("residual_dry"), -F.col("residual_wet"))
    names = ["mse_dry", "mse_wet", "cross", "mse_total"]
    out = predicted(spark, d).groupBy("pressure_hpa").agg(*(m.alias(f"m{k}") for k, m in enumerate(model[:4])), *(b.alias(f"b{k}") for k, b in enumerate(base[:4])))
    return out.select("pressure_hpa", *(r6(F.col(f"m{k}") - F.col(f"b{k}"), "cross_term" if c == "cross" else c) for k, c in enumerate(names)))


@query("AG10", f"WITH {PRED} SELECT station_no, pressure_hpa, count(*) AS n, round(sqrt(avg(error * error)), 6) AS rmse, round(sqrt(avg(residual_total * residual_total)), 6) AS background_rmse, round(sqrt(avg(error * error)) - sqrt(avg(residual_total * residual_total)), 6) AS gain, CASE WHEN count(*) >= 30 THEN 'valid' ELSE 'few_samples' END AS status FROM pred GROUP BY ALL")
def gains(spark, d):
    rmse = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    a, b = rmse("error"), rmse("residual_total")
    return predicted(spark, d).groupBy("station_no", "pressure_hpa").agg(F.count("*").alias("n"), r6(a, "rmse"), r6(b, "background_rmse"), r6(a - b, "gain"), F.when(F.count("*") >= 30, "valid").otherwise("few_samples").alias("status"))


@query("AG12", f"""WITH {PRED}, l AS (SELECT * FROM (VALUES {", ".join(f"(CAST({a} AS DOUBLE), CAST({z!r} AS DOUBLE))" for a, z in scores.QUANTILES.items())}) t(nominal, z))
SELECT coalesce(CAST(pressure_hpa AS VARCHAR), 'all') AS level, nominal, count(*) AS n, round(avg(CASE WHEN abs(error) <= sd * z THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(2 * sd * z), 6) AS width FROM pred, l GROUP BY GROUPING SETS ((pressure_hpa, nominal), (nominal))""")
def coverage_curve(spark, d):
    levels = F.array(*(F.struct(F.lit(a).alias("nominal"), F.lit(z).alias("z")) for a, z in scores.QUANTILES.items()))
    rows = predicted(spark, d).select(F.col("pressure_hpa").cast("string").alias("level"), "error", "sd", F.explode(levels).alias("q")).select("level", "error", "sd", "q.*")
    c = [F.col("level"), F.col("nominal")]
    out = rows.groupingSets([c, [c[1]]], *c).agg(F.count("*").alias("n"), r6(F.avg((F.abs("error") <= F.col("sd") * F.col("z")).cast("double")), "coverage"), r6(F.avg(2 * F.col("sd") * F.col("z")), "width"))
    return out.fillna("all", ["level"])


_ZZ = "(error / sd)"


@query("AG13", f"WITH {PRED} SELECT pressure_hpa, round(avg({_ZZ}), 6) AS z_mean, round(stddev_pop({_ZZ}), 6) AS z_sd, round(avg(CASE WHEN abs({_ZZ}) > 1.645 THEN 1.0 ELSE 0.0 END), 6) AS beyond_90, round(avg(CASE WHEN abs({_ZZ}) > 3 THEN 1.0 ELSE 0.0 END), 6) AS beyond_3, round(corr(sd, abs(error)), 6) AS sd_error_correlation, round(kurtosis_pop({_ZZ}), 5) AS excess_kurtosis FROM pred GROUP BY 1")
def shape(spark, d):
    z = F.col("error") / F.col("sd")
    share = lambda limit: F.avg((F.abs(z) > limit).cast("double"))
    return predicted(spark, d).groupBy("pressure_hpa").agg(
        r6(F.avg(z), "z_mean"), r6(F.stddev_pop(z), "z_sd"), r6(share(1.645), "beyond_90"), r6(share(3), "beyond_3"), r6(F.corr("sd", F.abs("error")), "sd_error_correlation"), F.round(F.kurtosis(z), 5).alias("excess_kurtosis")
    )


@query("AG20", f"""WITH {OBS}, r AS (SELECT station_no, {_SEASON} AS season, residual_total AS r FROM obs WHERE valid), m AS (SELECT r, avg(r) OVER (PARTITION BY station_no) AS s, avg(r) OVER (PARTITION BY station_no, season) AS ss FROM r)
SELECT count(*) AS n, round(avg(s * s), 6) AS persistent, round(avg(pow(ss - s, 2)), 6) AS seasonal, round(avg(pow(r - ss, 2)), 6) AS remainder, round(avg(r * r), 6) AS total FROM m""")
def variance_components(spark, d):
    """Count, sum and squares by station and season, then by station: the parts follow from these, whatever a station's size."""
    r, season = F.col("residual_total"), geo.season(F.col("time"))
    cells = observed(spark, d).where("valid").groupBy("station_no", season.alias("season")).agg(F.count("*").alias("n"), F.avg(r).alias("m"), F.sum(r * r).alias("squares"), (F.var_pop(r) * F.count("*")).alias("spread"))
    n, m = F.col("n"), F.col("m")
    stations = cells.groupBy("station_no").agg(F.sum(n).alias("n"), (F.sum(n * m) / F.sum(n)).alias("s"), F.sum(n * m * m).alias("nmm"), F.sum("spread").alias("spread"), F.sum("squares").alias("squares"))
    s, total = F.col("s"), F.sum("n")
    return stations.agg(total.alias("n"), r6(F.sum(n * s * s) / total, "persistent"), r6(F.sum(F.col("nmm") - n * s * s) / total, "seasonal"), r6(F.sum("spread") / total, "remainder"), r6(F.sum("squares") / total, "total"))


@query("AG21", f"""WITH {OBS}, p AS (SELECT CASE WHEN latitude >= 30 THEN 'north' WHEN latitude <= -30 THEN 'south' ELSE 'tropics' END AS region, station_no, profile_no, count(*) FILTER (valid) AS v FROM obs GROUP BY ALL)
SELECT region, count(DISTINCT station_no) AS stations, count(*) AS profiles, count(*) FILTER (v >= 3) AS eligible, round(1 - sum(v) / (6.0 * count(*)), 6) AS missing_fraction, round(median(v), 6) AS median_levels FROM p GROUP BY 1""")
def retention(spark, d):
    p = observed(spark, d).groupBy(geo.region(F.col("latitude")).alias("region"), "station_no", "profile_no").agg(F.count_if("valid").alias("v"))
    return p.groupBy("region").agg(F.count_distinct("station_no").alias("stations"), F.count("*").alias("profiles"), F.count_if(F.col("v") >= 3).alias("eligible"), r6(1 - F.sum("v") / (6.0 * F.count("*")), "missing_fraction"), r6(F.median("v"), "median_levels"))


@query("AG22", f"""WITH {OBS}, s AS (SELECT station_no, count(DISTINCT profile_no) FILTER (time < TIMESTAMP '{DEV}') AS a, count(DISTINCT profile_no) FILTER (time >= TIMESTAMP '{DEV}' AND time < TIMESTAMP '{CAL}') AS b, count(DISTINCT profile_no) FILTER (time >= TIMESTAMP '{CAL}') AS c FROM obs GROUP BY 1)
SELECT station_no, a AS development, b AS calibration, c AS evaluation, a >= 60 AND b >= 8 AND c >= 35 AS eligible, concat_ws(';', CASE WHEN a < 60 THEN 'development' END, CASE WHEN b < 8 THEN 'calibration' END, CASE WHEN c < 35 THEN 'evaluation' END) AS failures FROM s""")
def eligibility(spark, d):
    t, p = F.col("time"), F.col("profile_no")
    count = lambda ok: F.count_distinct(F.when(ok, p))
    s = observed(spark, d).groupBy("station_no").agg(count(t < _at(DEV)).alias("development"), count((t >= _at(DEV)) & (t < _at(CAL))).alias("calibration"), count(t >= _at(CAL)).alias("evaluation"))
    least = {"development": 60, "calibration": 8, "evaluation": 35}
    failures = F.concat_ws(";", *(F.when(F.col(k) < n, k) for k, n in least.items()))
    return s.withColumn("failures", failures).withColumn("eligible", F.col("failures") == "")


@query("AG28", f"""WITH {PRED}, e AS (SELECT quantile_cont(sd, [0.2, 0.4, 0.6, 0.8]) AS q FROM pred WHERE time >= TIMESTAMP '{DEV}' AND time < TIMESTAMP '{CAL}')
SELECT 1 + len(list_filter(e.q, lambda x: x <= sd)) AS quintile, count(*) AS n, round(avg(CASE WHEN abs(error) <= sd * CAST({scores.QUANTILES[0.9]!r} AS DOUBLE) THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM pred, e WHERE time >= TIMESTAMP '{CAL}' GROUP BY 1""")
def conditional_coverage(spark, d):
    rows = predicted(spark, d).select("time", "error", "sd")
    some = rows.where((F.col("time") >= _at(DEV)) & (F.col("time") < _at(CAL)))
    cuts = quantiles.quantiles(some, F.col("sd"), [], [k / 5 for k in range(1, 5)]).agg(F.array_sort(F.collect_list("q")).alias("q"))  # four numbers
    late = rows.where(F.col("time") >= _at(CAL)).crossJoin(F.broadcast(cuts))  # one row
    quintile = (1 + F.size(F.filter("q", lambda x: x <= F.col("sd")))).cast("long")
    return late.groupBy(quintile.alias("quintile")).agg(F.count("*").alias("n"), r6(F.avg((F.abs("error") <= F.col("sd") * scores.QUANTILES[0.9]).cast("double")), "coverage"))


_SEEDS = (11, 23, 42)


@query("AG31", f"""WITH {PRED}, s AS (SELECT seed, sqrt(avg(pow(error + seed % 7 * CAST(0.01 AS DOUBLE), 2))) AS rmse, avg(error + seed % 7 * CAST(0.01 AS DOUBLE)) AS bias FROM pred, (SELECT unnest([11, 23, 42]) AS seed) GROUP BY 1)
SELECT count(*) AS runs, round(avg(rmse), 6) AS rmse_mean, round(stddev_samp(rmse), 6) AS rmse_sd, round(avg(bias), 6) AS bias_mean, round(stddev_samp(bias), 6) AS bias_sd FROM s""")
def repeated_runs(spark, d):
    rows = predicted(spark, d).select("error", F.explode(F.array(*(F.lit(s) for s in _SEEDS))).alias("seed"))
    e = F.col("error") + F.col("seed") % 7 * 0.01
    s = rows.groupBy("seed").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))
    return s.agg(F.count("*").alias("runs"), *(f(F.col(c)) for c in ("rmse", "bias") for f in (lambda x, c=c: r6(F.avg(x), f"{c}_mean"), lambda x, c=c: r6(F.stddev_samp(x), f"{c}_sd"))))


@query("AG32", f"""WITH {PRED}, m AS (SELECT strftime(time, '%Y-%m') AS month, count(*) AS n, sqrt(avg(error * error)) - sqrt(avg(residual_total * residual_total)) AS x FROM pred GROUP BY 1)
SELECT substr(month, 1, 4) AS year, count(*) AS months, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(sum(n * x) / sum(n), 6) AS weighted, round(avg(CASE WHEN x < 0 THEN 1.0 ELSE 0.0 END), 6) AS improved FROM m GROUP BY 1""")
def blocks(spark, d):
    rmse = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    m = predicted(spark, d).groupBy(F.date_format("time", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), (rmse("error") - rmse("residual_total")).alias("x"))
    x = F.col("x")
    return m.groupBy(F.substring("month", 1, 4).alias("year")).agg(F.count("*").alias("months"), r6(F.avg(x), "mean"), r6(F.median(x), "median"), r6(F.sum(F.col("n") * x) / F.sum("n"), "weighted"), r6(F.avg((x < 0).cast("double")), "improved"))


@query("AG33", f"WITH {src.LEVELS_SQL} SELECT strftime(time, '%Y-%m') AS archive, count(DISTINCT profile_no) AS profiles, count(DISTINCT CAST(time AS DATE)) AS days, min(time) AS first_time, max(time) AS last_time, round(count(*) / sum(count(*)) OVER (), 6) AS row_fraction FROM lv GROUP BY 1")
def archives(spark, d):
    a = src.levels(spark, d).groupBy(F.date_format("time", "yyyy-MM").alias("archive")).agg(F.count_distinct("profile_no").alias("profiles"), F.count_distinct(F.to_date("time")).alias("days"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.count("*").alias("n"))
    whole = a.agg(F.sum("n").alias("all"))
    out = a.crossJoin(F.broadcast(whole)).withColumn("row_fraction", F.round(F.col("n") / F.col("all"), 6)).drop("n", "all")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_time", "last_time")})


@query("AG37", f"""WITH {PRED}, s AS (SELECT station_no, sqrt(avg(error * error)) - sqrt(avg(residual_total * residual_total)) AS gain, min(elevation_m) AS elevation, min(abs(latitude)) AS latitude, count(*) AS n FROM pred GROUP BY 1),
r AS (SELECT {", ".join(f"rank() OVER (ORDER BY round({c}, 9)) + (count(*) OVER (PARTITION BY round({c}, 9)) - 1) / 2.0 AS {c}" for c in ("gain", "elevation", "latitude", "n"))} FROM s)
SELECT count(*) AS stations, round(corr(gain, elevation), 6) AS elevation, round(corr(gain, latitude), 6) AS latitude, round(corr(gain, n), 6) AS n FROM r""")
def rank_correlation(spark, d):
    """Ranks over one row per station."""
    rmse = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    s = predicted(spark, d).groupBy("station_no").agg((rmse("error") - rmse("residual_total")).alias("gain"), F.min("elevation_m").alias("elevation"), F.min(F.abs("latitude")).alias("latitude"), F.count("*").alias("n"))
    names = ("gain", "elevation", "latitude", "n")
    rank = lambda c: F.rank().over(Window.orderBy(F.round(c, 9))) + (F.count("*").over(Window.partitionBy(F.round(c, 9))) - 1) / 2.0
    r = s.select(*(rank(c).alias(c) for c in names))
    return r.agg(F.count("*").alias("stations"), *(r6(F.corr("gain", c), c) for c in names[1:]))


@query("AG38", f"""WITH {OBS}, u AS (SELECT time, unnest(['temperature_k', 'q', 'height_m']) AS feature, unnest([temperature_k, q, height_m]) AS v FROM obs), t AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM u WHERE time < TIMESTAMP '{DEV}' GROUP BY 1)
SELECT feature, count(*) AS n, count(*) FILTER (v < lo) AS below, count(*) FILTER (v > hi) AS above, round(min(v), 6) AS low, round(max(v), 6) AS high FROM u JOIN t USING (feature) WHERE time >= TIMESTAMP '{DEV}' GROUP BY 1""")
def feature_ranges(spark, d):
    u = observed(spark, d).select("time", "temperature_k", "q", "height_m").unpivot("time", ["temperature_k", "q", "height_m"], "feature", "v")
    t = u.where(F.col("time") < _at(DEV)).groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    rows = u.where(F.col("time") >= _at(DEV)).join(F.broadcast(t), "feature")
    return rows.groupBy("feature").agg(F.count("*").alias("n"), F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count_if(F.col("v") > F.col("hi")).alias("above"), r6(F.min("v"), "low"), r6(F.max("v"), "high"))


@query("AG39", f"WITH {src.LEVELS_SQL} SELECT count(DISTINCT profile_no) AS profiles, count(DISTINCT station_no) AS stations, count(DISTINCT strftime(time, '%Y-%m')) AS archives, count(DISTINCT CAST(time AS DATE)) AS days FROM lv")
def distinct_counts(spark, d):
    return src.levels(spark, d).agg(F.count_distinct("profile_no").alias("profiles"), F.count_distinct("station_no").alias("stations"), F.count_distinct(F.date_format("time", "yyyy-MM")).alias("archives"), F.count_distinct(F.to_date("time")).alias("days"))


@query("AG42", f"WITH {PRED}, y AS (SELECT year(time) AS year, count(*) AS n, sqrt(avg(error * error)) AS rmse FROM pred GROUP BY 1) SELECT CAST(year AS INT) AS year, n, round(rmse, 6) AS rmse, round(max(rmse) OVER () - min(rmse) OVER (), 6) AS range FROM y")
def years(spark, d):
    e = F.col("error")
    y = predicted(spark, d).groupBy(F.year("time").alias("year")).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"))
    span = y.agg((F.max("rmse") - F.min("rmse")).alias("range"))
    return y.crossJoin(F.broadcast(span)).select("year", "n", r6("rmse", "rmse"), r6("range", "range"))


@query("AG43", f"WITH {OBS} SELECT pressure_hpa, round(avg(residual_total), 6) AS n_part, round(avg(CAST(0.157 AS DOUBLE) * (height_m - h)), 6) AS height_part, round(avg(residual_total + CAST(0.157 AS DOUBLE) * (height_m - h)), 6) AS total FROM (SELECT *, avg(height_m) OVER (PARTITION BY pressure_hpa) AS h FROM obs) GROUP BY 1")
def modified_parts(spark, d):
    rows = observed(spark, d)
    mean = rows.groupBy("pressure_hpa").agg(F.avg("height_m").alias("h"))  # six rows
    h = 0.157 * (F.col("height_m") - F.col("h"))
    return rows.join(F.broadcast(mean), "pressure_hpa").groupBy("pressure_hpa").agg(r6(F.avg("residual_total"), "n_part"), r6(F.avg(h), "height_part"), r6(F.avg(F.col("residual_total") + h), "total"))


@query("AG45", f"""WITH {PRED}, s AS (SELECT *, unnest(list_filter(['all', CASE WHEN time >= TIMESTAMP '{CAL}' THEN 'late' END, CASE WHEN abs(latitude) < 30 THEN 'low_latitude' END, CASE WHEN time >= TIMESTAMP '{CAL}' AND abs(latitude) < 30 THEN 'both' END], lambda x: x IS NOT NULL)) AS subset FROM pred)
SELECT subset, count(*) AS n, count(DISTINCT station_no) AS clusters, count(DISTINCT profile_no) AS profiles, round(sqrt(avg(error * error)), 6) AS rmse, CASE WHEN count(DISTINCT station_no) >= 10 THEN 'valid' ELSE 'few_clusters' END AS status FROM s GROUP BY 1""")
def subsets(spark, d):
    late, low = F.col("time") >= _at(CAL), F.abs("latitude") < 30
    labels = F.array_compact(F.array(F.lit("all"), F.when(late, "late"), F.when(low, "low_latitude"), F.when(late & low, "both")))
    rows = predicted(spark, d).select("error", "station_no", "profile_no", F.explode(labels).alias("subset"))
    e, k = F.col("error"), F.count_distinct("station_no")
    return rows.groupBy("subset").agg(F.count("*").alias("n"), k.alias("clusters"), F.count_distinct("profile_no").alias("profiles"), r6(F.sqrt(F.avg(e * e)), "rmse"), F.when(k >= 10, "valid").otherwise("few_clusters").alias("status"))


@query("AG46", f"WITH {src.LEVELS_SQL} SELECT count(*) AS n_rows, min(time) AS first_time, max(time) AS last_time, count(*) FILTER (dewpoint_depression_c IS NULL) AS no_dewpoint, count(*) FILTER (relative_humidity IS NULL) AS no_humidity, count(*) FILTER (temperature_k IS NULL) AS no_temperature FROM lv")
def summary(spark, d):
    none = lambda c: F.count_if(F.col(c).isNull())
    out = src.levels(spark, d).agg(F.count("*").alias("n_rows"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), none("dewpoint_depression_c").alias("no_dewpoint"), none("relative_humidity").alias("no_humidity"), none("temperature_k").alias("no_temperature"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_time", "last_time")})


@query("JN1", f"""WITH {PRED}, {src.STATIONS_SQL} SELECT p.{LEVEL}, count(*) AS n, count(DISTINCT s.station_no) AS stations, round(sqrt(avg(pow(p.correction - o.residual_total, 2))), 6) AS rmse, round(avg(s.elevation_m), 6) AS elevation_m
FROM pred p JOIN obs o ON o.profile_no = p.profile_no AND o.{LEVEL} = p.{LEVEL} JOIN stations s ON s.station_no = p.station_no GROUP BY 1""")
def checked_joins(spark, d):
    """Predictions meet their reports one to one and their stations many to one; a key that comes twice, or one without a match, stops the query."""
    p = predicted(spark, d).select("profile_no", LEVEL, "station_no", "correction")
    o = observed(spark, d).select("profile_no", LEVEL, "residual_total")
    both = checks.checked_join(p, o, ["profile_no", LEVEL], "one_to_one")
    both = checks.checked_join(both, src.stations(spark, d).select("station_no", "elevation_m"), ["station_no"], "many_to_one")
    e = F.col("correction") - F.col("residual_total")
    return both.groupBy(LEVEL).agg(F.count("*").alias("n"), F.count_distinct("station_no").alias("stations"), r6(F.sqrt(F.avg(e * e)), "rmse"), r6(F.avg("elevation_m"), "elevation_m"))


@query("JN3", f"""WITH {OBS}, t AS (SELECT * FROM obs WHERE valid AND time < TIMESTAMP '{DEV}'), a AS (SELECT pressure_hpa, month(time) AS m, hour(time) AS h, avg(residual_total) AS x FROM t GROUP BY ALL), b AS (SELECT pressure_hpa, avg(residual_total) AS y FROM t GROUP BY 1)
SELECT o.pressure_hpa, count(*) AS n, round(avg(coalesce(x, y, 0)), 6) AS prediction, count(x) AS exact FROM obs o LEFT JOIN a ON a.pressure_hpa = o.pressure_hpa AND a.m = month(o.time) AND a.h = hour(o.time) LEFT JOIN b ON b.pressure_hpa = o.pressure_hpa WHERE o.time >= TIMESTAMP '{DEV}' GROUP BY 1""")
def lookup_chain(spark, d):
    rows = observed(spark, d).withColumn("m", F.month("time")).withColumn("h", F.hour("time"))
    t = rows.where(F.col("valid") & (F.col("time") < _at(DEV)))
    a = t.groupBy("pressure_hpa", "m", "h").agg(F.avg("residual_total").alias("x"))  # 6 x 12 x 24 rows at most
    b = t.groupBy("pressure_hpa").agg(F.avg("residual_total").alias("y"))
    out = rows.where(F.col("time") >= _at(DEV)).join(F.broadcast(a), ["pressure_hpa", "m", "h"], "left").join(F.broadcast(b), "pressure_hpa", "left")
    return out.groupBy("pressure_hpa").agg(F.count("*").alias("n"), r6(F.avg(F.coalesce("x", "y", F.lit(0.0))), "prediction"), F.count("x").alias("exact"))


@query("JN17", f"""WITH {OBS}, a AS (SELECT profile_no, pressure_hpa FROM obs WHERE valid AND NOT below_ground), b AS (SELECT profile_no, pressure_hpa FROM obs WHERE valid AND pressure_hpa * 100 <= surface_pressure_pa - 2000)
SELECT coalesce(a.pressure_hpa, b.pressure_hpa) AS pressure_hpa, CASE WHEN a.profile_no IS NOT NULL AND b.profile_no IS NOT NULL THEN 'common_valid' WHEN a.profile_no IS NOT NULL THEN 'first_only' ELSE 'second_only' END AS change, count(*) AS n FROM a FULL JOIN b ON a.profile_no = b.profile_no AND a.pressure_hpa = b.pressure_hpa GROUP BY ALL""")
def paired_validity(spark, d):
    rows = observed(spark, d).where("valid").select("profile_no", "pressure_hpa", "below_ground", "surface_pressure_pa")
    a = rows.where("NOT below_ground").select("profile_no", "pressure_hpa", F.lit(True).alias("a"))
    b = rows.where("pressure_hpa * 100 <= surface_pressure_pa - 2000").select("profile_no", "pressure_hpa", F.lit(True).alias("b"))
    change = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "common_valid").when(F.col("a").isNotNull(), "first_only").otherwise("second_only")
    return a.join(b, ["profile_no", "pressure_hpa"], "full").groupBy("pressure_hpa", change.alias("change")).agg(F.count("*").alias("n"))


#: Fixed windows of a protocol: phase, parts of the station split, first time, first time after it. The last two overlap on purpose.
_PHASES = (("train", ("train",), "1990-01-01", DEV), ("calibration", ("train", "calibration"), DEV, CAL), ("evaluation", ("train", "calibration", "test"), "1999-06-01", "2010-01-01"), ("holdout", ("test",), "1990-01-01", "1999-07-15"))


@query("JN20", f"""WITH {src.LEVELS_SQL}, {src.STATIONS_SQL}, r AS (SELECT station_no, row_number() OVER (ORDER BY md5('42:' || station_no), station_no) - 1 AS i, count(*) OVER () AS n FROM stations),
s AS (SELECT station_no, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.7) + floor(n * 0.1) THEN 'calibration' ELSE 'test' END AS role FROM r),
p(phase, role, low, high) AS (VALUES {", ".join(f"('{p}', '{r}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for p, roles, a, b in _PHASES for r in roles)}),
k AS (SELECT DISTINCT phase, lv.station_no, time FROM lv JOIN s USING (station_no) JOIN p ON p.role = s.role AND time >= low AND time < high)
SELECT a.phase AS left_phase, b.phase AS right_phase, count(*) AS shared FROM k a JOIN k b ON a.station_no = b.station_no AND a.time = b.time AND a.phase < b.phase GROUP BY ALL""")
def leakage(spark, d):
    """Station-time keys that two phases of a protocol share; phases come from a station split and from time windows, so they can."""
    split = resampling.split(src.stations(spark, d), "station_no", 42).select("station_no", "role")
    rows = src.levels(spark, d).select("station_no", "time").join(F.broadcast(split), "station_no")  # a row a station
    phases = {p: rows.where(F.col("role").isin(*roles) & (F.col("time") >= _at(a)) & (F.col("time") < _at(b))) for p, roles, a, b in _PHASES}
    return checks.overlaps(phases, ["station_no", "time"])


@query("JN21", f"WITH {OBS} SELECT o_orderkey AS profile_no FROM orders ANTI JOIN (SELECT DISTINCT profile_no FROM obs WHERE valid) v ON v.profile_no = o_orderkey")
def missing_inputs(spark, d):
    orders = src.table(spark, d, "orders", "o_orderkey").withColumnRenamed("o_orderkey", "profile_no")
    return orders.join(observed(spark, d).where("valid").select("profile_no"), "profile_no", "left_anti")


_FROZEN = f"""{PRED}, c2 AS (SELECT pressure_hpa, month(time) AS m, sum(residual_total) / count(*) AS c FROM obs WHERE valid AND NOT below_ground AND time < TIMESTAMP '{DEV}' GROUP BY ALL),
old AS (SELECT o.profile_no, o.pressure_hpa, NOT below_ground AND surface_pressure_pa - 2000 >= o.pressure_hpa * 100 AS mask, c AS correction, tax * 20 + CAST(0.5 AS DOUBLE) + CASE WHEN o.profile_no % 97 = 0 THEN CAST(0.001 AS DOUBLE) ELSE 0 END AS sd
  FROM obs o LEFT JOIN c2 ON c2.pressure_hpa = o.pressure_hpa AND c2.m = month(o.time) WHERE valid AND o.profile_no % 50 <> 0)"""


@query("DQ6", f"""WITH {_FROZEN}, new AS (SELECT profile_no, pressure_hpa, true AS mask, correction, sd FROM pred),
j AS (SELECT n.mask AS nm, o.mask AS om, coalesce(n.mask AND o.mask, false) AS use, n.correction AS nc, o.correction AS oc, n.sd AS ns, o.sd AS os FROM new n FULL JOIN old o ON n.profile_no = o.profile_no AND n.pressure_hpa = o.pressure_hpa),
l AS (SELECT nm, om, use, unnest(['correction', 'sd']) AS "column", unnest([nc, ns]) AS x, unnest([oc, os]) AS y FROM j),
r AS (SELECT "column", count(*) FILTER (use) AS n_common, count(*) FILTER (nm <> om) AS mask_disagreements, count(*) FILTER (om IS NULL) AS only_new, count(*) FILTER (nm IS NULL) AS only_old, max(abs(x - y)) FILTER (use) AS max_abs FROM l GROUP BY 1)
SELECT "column", n_common, mask_disagreements, only_new, only_old, round(max_abs, 6) AS max_abs, mask_disagreements + only_new + only_old = 0 AND max_abs <= 1e-6 AS same FROM r""")
def compare_predictions(spark, d):
    """Today's predictions against another set of the same rows: a stricter mask, fewer profiles, means by another formula, a few other spreads."""
    new = predicted(spark, d).select("profile_no", "pressure_hpa", F.lit(True).alias("mask"), "correction", "sd")
    rows = observed(spark, d).where("valid")
    early = rows.where(~F.col("below_ground") & (F.col("time") < _at(DEV)))
    means = early.groupBy("pressure_hpa", F.month("time").alias("m")).agg((F.sum("residual_total") / F.count("*")).alias("correction"))  # 72 rows at most
    strict = ~F.col("below_ground") & (F.col("surface_pressure_pa") - 2000 >= F.col("pressure_hpa") * 100)
    sd = F.col("tax") * 20 + 0.5 + F.when(F.col("profile_no") % 97 == 0, 0.001).otherwise(0.0)
    old = rows.where("profile_no % 50 <> 0").withColumn("m", F.month("time")).join(F.broadcast(means), ["pressure_hpa", "m"], "left").select("profile_no", "pressure_hpa", strict.alias("mask"), "correction", sd.alias("sd"))
    out = checks.compared(new, old, ["profile_no", "pressure_hpa"], "mask", ["correction", "sd"], 1e-6)
    return out.withColumn("max_abs", F.round("max_abs", 6))


@query("DQ13", f"""WITH {PRED}, s AS (SELECT pressure_hpa, CASE WHEN latitude >= 30 THEN 'north' WHEN latitude <= -30 THEN 'south' ELSE 'tropics' END AS region, station_no, avg(error) AS x FROM pred WHERE elevation_m < 400 GROUP BY ALL)
SELECT pressure_hpa, region, count(*) AS clusters, CASE WHEN count(*) >= 4 THEN round(avg(x), 6) END AS mean, CASE WHEN count(*) >= 4 THEN 'valid' ELSE 'suppressed' END AS status FROM s GROUP BY ALL""")
def suppression(spark, d):
    s = predicted(spark, d).where("elevation_m < 400").groupBy("pressure_hpa", geo.region(F.col("latitude")).alias("region"), "station_no").agg(F.avg("error").alias("x"))
    k = F.count("*")
    return s.groupBy("pressure_hpa", "region").agg(k.alias("clusters"), F.when(k >= 4, F.round(F.avg("x"), 6)).alias("mean"), F.when(k >= 4, "valid").otherwise("suppressed").alias("status"))


@query("DQ15", f"WITH {src.TARGETS_SQL}, s AS (SELECT DISTINCT CAST(floor(tpos) AS BIGINT) AS t FROM targets), e AS (SELECT unnest(range(0, (SELECT max(t) + 1 FROM s))) AS t) SELECT count(*) AS expected, count(s.t) AS found, count(*) - count(s.t) AS missing FROM e LEFT JOIN s USING (t)")
def grid_coverage(spark, d):
    s = src.targets(spark, d).select(F.floor("tpos").alias("t")).distinct()
    expected = s.agg(F.explode(F.sequence(F.lit(0).cast("long"), F.max("t"))).alias("t"))
    return expected.join(s.withColumn("there", F.lit(1)), "t", "left").agg(F.count("*").alias("expected"), F.count("there").alias("found"), F.count_if(F.col("there").isNull()).alias("missing"))


@query("SL5", f"WITH {src.STATIONS_SQL}, r AS (SELECT station_no, row_number() OVER (ORDER BY station_no) - 1 AS i, count(*) OVER () AS n FROM stations) SELECT station_no FROM r WHERE i IN (SELECT CAST(floor(k * (n - 1) / 11.0) AS BIGINT) FROM range(12) t(k))")
def spaced(spark, d):
    """A sampling operator: twelve evenly spaced stations of a table with one row per station."""
    s = src.stations(spark, d).select("station_no", (F.row_number().over(Window.orderBy("station_no")) - 1).alias("i"))
    n = s.agg(F.count("*").alias("n")).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.floor(k * (F.col("n") - 1) / 11.0))).alias("i"))
    return s.join(F.broadcast(n.distinct()), "i", "left_semi").select("station_no")


@query("SO4", f"WITH {src.LEVELS_SQL}, a AS (SELECT DISTINCT station_no FROM lv WHERE time < TIMESTAMP '{DEV}'), b AS (SELECT DISTINCT station_no FROM lv WHERE time >= TIMESTAMP '{CAL}') SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS both, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS early_only, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS late_only")
def key_sets(spark, d):
    rows = src.levels(spark, d)
    a, b = rows.where(F.col("time") < _at(DEV)).select("station_no"), rows.where(F.col("time") >= _at(CAL)).select("station_no")
    count = lambda df, name: df.distinct().agg(F.count("*").alias(name))
    return count(a.intersect(b), "both").crossJoin(count(a.distinct().exceptAll(b.distinct()), "early_only")).crossJoin(count(b.distinct().exceptAll(a.distinct()), "late_only"))


@query("ML5", f"""WITH {src.STATIONS_SQL}, f AS (SELECT station_no, CAST((row_number() OVER (ORDER BY md5('11:' || station_no), station_no) - 1) % 5 AS INT) AS fold FROM stations), {OBS},
t AS (SELECT o.pressure_hpa, f.fold, count(*) AS n, sum(residual_total) AS s FROM obs o JOIN f USING (station_no) WHERE valid GROUP BY ALL), w AS (SELECT pressure_hpa, fold, (sum(s) OVER (PARTITION BY pressure_hpa) - s) / (sum(n) OVER (PARTITION BY pressure_hpa) - n) AS c FROM t)
SELECT o.pressure_hpa, f.fold, count(*) AS n, round(sqrt(avg(pow(residual_total - c, 2))), 6) AS rmse FROM obs o JOIN f USING (station_no) JOIN w ON w.pressure_hpa = o.pressure_hpa AND w.fold = f.fold WHERE valid GROUP BY ALL""")
def cross_fit(spark, d):
    folds = resampling.folds(src.stations(spark, d), "station_no", 11, 5).select("station_no", F.col("fold").cast("int").alias("fold"))
    rows = observed(spark, d).where("valid").join(F.broadcast(folds), "station_no")
    t = rows.groupBy("pressure_hpa", "fold").agg(F.count("*").alias("n"), F.sum("residual_total").alias("s"))  # 30 rows
    by = Window.partitionBy("pressure_hpa")
    w = t.select("pressure_hpa", "fold", ((F.sum("s").over(by) - F.col("s")) / (F.sum("n").over(by) - F.col("n"))).alias("c"))
    e = F.col("residual_total") - F.col("c")
    return rows.join(F.broadcast(w), ["pressure_hpa", "fold"]).groupBy("pressure_hpa", "fold").agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(e * e)), "rmse"))


@query("AR6", f"""WITH {PRED}, a AS (SELECT profile_no, pressure_hpa, sd, list_position([1000, 925, 850, 700, 500, 300], pressure_hpa) AS i FROM pred)
SELECT a.pressure_hpa AS level_a, b.pressure_hpa AS level_b, count(*) AS n, round(avg(a.sd * b.sd * pow(CAST(0.6 AS DOUBLE), abs(a.i - b.i))), 6) AS covariance FROM a JOIN a b ON a.profile_no = b.profile_no AND a.i <= b.i GROUP BY ALL""")
def covariances(spark, d):
    """Pairs of levels within a profile's own row; covariances of 21 pairs in one aggregation."""
    wide, at = side_by_side(predicted(spark, d), "sd"), list(enumerate(src.LEVELS))
    pairs = []
    for i, a in at:
        for j, b in at[i:]:
            cov = F.col(f"x{a}") * F.col(f"x{b}") * 0.6 ** (j - i)
            pairs.append(F.struct(F.lit(a).alias("level_a"), F.lit(b).alias("level_b"), F.count(cov).alias("n"), r6(F.avg(cov), "covariance")))
    return wide.agg(F.array(*pairs).alias("pairs")).select(F.inline("pairs")).where("n > 0")
