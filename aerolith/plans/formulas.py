"""Formulas, filters, windows and selections over sounding levels and stations, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from aerolith.functions import atmosphere, geo, scores
from aerolith.operators import profiles
from aerolith.plans.registry import d, r6, registry
from aerolith.plans.soundings import _ES, OBS, PRED, VALID, observed, predicted, valid
from aerolith.sources import levels as src

Q, SQL, query = registry()
LEVEL = "pressure_hpa"
_TC = f"(temperature_k - {d(273.15)})"


def by_level(df, *columns: Column):
    return df.groupBy(LEVEL).agg(*columns)


@query("SF2", f"""WITH {src.LEVELS_SQL}, e AS (SELECT CASE WHEN dewpoint_depression_c >= 0 THEN 'dewpoint_depression' WHEN relative_humidity BETWEEN 0 AND 110 THEN 'relative_humidity' ELSE 'missing' END AS source,
  CASE WHEN dewpoint_depression_c >= 0 THEN {_ES.format(f"({_TC} - dewpoint_depression_c)")} WHEN relative_humidity BETWEEN 0 AND 110 THEN relative_humidity / 100 * {_ES.format(_TC)} END AS e FROM lv)
SELECT source, count(*) AS n, round(avg(e), 6) AS e, round(max(e), 6) AS most FROM e GROUP BY 1""")
def vapour_pressure(spark, path):
    e, source = atmosphere.vapor_pressure(F.col("temperature_k") - 273.15, F.col("dewpoint_depression_c"), F.col("relative_humidity"))
    return src.levels(spark, path).groupBy(source.alias("source")).agg(F.count("*").alias("n"), r6(F.avg(e), "e"), r6(F.max(e), "most"))


@query("SF5", f"WITH {src.LEVELS_SQL} SELECT {LEVEL}, count(*) FILTER (bg_q - {d(0.002)} < 0) AS n_clipped, round(1000 * avg(greatest(bg_q - {d(0.002)}, 0)), 6) AS g_kg FROM lv GROUP BY 1")
def humidity_clip(spark, path):
    q = F.col("bg_q") - 0.002
    return by_level(src.levels(spark, path), F.count_if(q < 0).alias("n_clipped"), r6(1000 * F.avg(F.greatest(q, F.lit(0.0))), "g_kg"))


@query("SF7", f"WITH {src.LEVELS_SQL} SELECT {LEVEL}, round(any_value(44330 * (1 - pow({LEVEL} / {d(1013.25)}, {d(0.1903)}))), 6) AS standard_m, round(avg(height_m - 44330 * (1 - pow({LEVEL} / {d(1013.25)}, {d(0.1903)}))), 6) AS departure_m FROM lv GROUP BY 1")
def standard_height(spark, path):
    h = atmosphere.standard_height(F.col(LEVEL))
    return by_level(src.levels(spark, path), r6(F.first(h), "standard_m"), r6(F.avg(F.col("height_m") - h), "departure_m"))


@query("SF8", f"WITH {OBS} SELECT {LEVEL}, round(avg(obs_total + {d(0.157)} * height_m), 6) AS m_obs, round(avg(bg_total + {d(0.157)} * height_m), 6) AS m_bg FROM obs WHERE valid GROUP BY 1")
def modified_refractivity(spark, path):
    m = lambda c: F.avg(atmosphere.modified_refractivity(F.col(c), F.col("height_m")))
    return by_level(observed(spark, path).where("valid"), r6(m("obs_total"), "m_obs"), r6(m("bg_total"), "m_bg"))


def _hav(lat: str, lon: str) -> str:
    return f"pow(sin((radians({lat}) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians({lat})) * pow(sin(radians({lon} - longitude) / 2), 2)"


_H = f"({_hav('48', '11')})"


@query("SF9", f"WITH {src.STATIONS_SQL} SELECT station_no, round(2 * {d(6371.0088)} * asin(least(1, sqrt({_H}))), 6) AS km, round(2 * 6371 * asin(least(1, sqrt({_H}))), 6) AS km_6371, round(2 * 6371 * atan2(sqrt({_H}), sqrt(1 - {_H})), 6) AS km_atan2, round(2 * asin(least(1, sqrt({_H}))), 6) AS radians FROM stations")
def great_circle(spark, path):
    at = (F.col("latitude"), F.col("longitude"), F.lit(48.0), F.lit(11.0))
    half = F.pow(F.sin(geo.distance(*at, radius=1.0) / 2), F.lit(2))
    return src.stations(spark, path).select("station_no", r6(geo.distance(*at), "km"), r6(geo.distance(*at, radius=6371.0), "km_6371"), r6(2 * 6371 * F.atan2(F.sqrt(half), F.sqrt(1 - half)), "km_atan2"), r6(geo.distance(*at, radius=1.0), "radians"))


@query("SF10", f"WITH {src.STATIONS_SQL}, b AS (SELECT station_no, degrees(atan2(sin(radians(11 - longitude)) * cos(radians(48)), cos(radians(latitude)) * sin(radians(48)) - sin(radians(latitude)) * cos(radians(48)) * cos(radians(11 - longitude)))) + 360 AS x FROM stations) SELECT station_no, round(x - 360 * floor(x / 360), 6) AS bearing FROM b")
def initial_bearing(spark, path):
    return src.stations(spark, path).select("station_no", r6(geo.bearing(F.col("latitude"), F.col("longitude"), F.lit(48.0), F.lit(11.0)), "bearing"))


#: Anchors of the kernel features: latitude, longitude.
ANCHORS = ((60, 0), (0, 90), (-45, -120))


@query("SF11", "WITH " + src.STATIONS_SQL + ", k AS (SELECT station_no, " + ", ".join(f"2 * {d(6371.0088)} * asin(least(1, sqrt({_hav(str(a), str(o))}))) AS d{i}" for i, (a, o) in enumerate(ANCHORS)) + " FROM stations) SELECT station_no, " + ", ".join(f"round(exp(-pow(d{i} / 3000, 2) / 2), 6) AS gauss{i}, round(exp(-pow(d{i} / 5000, 2)), 6) AS wide{i}" for i in range(3)) + " FROM k")
def kernel_features(spark, path):
    """Three anchors, so three columns; no join."""
    out = [F.col("station_no")]
    for i, (a, o) in enumerate(ANCHORS):
        km = geo.distance(F.col("latitude"), F.col("longitude"), F.lit(float(a)), F.lit(float(o)))
        out += [r6(F.exp(-F.pow(km / 3000, F.lit(2)) / 2), f"gauss{i}"), r6(F.exp(-F.pow(km / 5000, F.lit(2))), f"wide{i}")]
    return src.stations(spark, path).select(*out)


@query("SF12", f"WITH {src.STATIONS_SQL}, x AS (SELECT station_no, longitude * 3 AS o FROM stations) SELECT station_no, round(o + 180 - 360 * floor((o + 180) / 360) - 180, 6) AS wrapped, round(o - 360 * floor(o / 360), 6) AS positive FROM x")
def longitudes(spark, path):
    o = F.col("longitude") * 3
    return src.stations(spark, path).select("station_no", r6(geo.wrapped(o), "wrapped"), r6(F.pmod(o, F.lit(360.0)), "positive"))


_F18 = {
    "t": "temperature_k", "q": "q", "h": "height_m / 10000", "n_dry": "obs_dry", "n_wet": "obs_wet", "n": "obs_total", "p": f"{LEVEL} / 1000", "sp": "surface_pressure_pa / 100000",
    "sin_lat": "sin(radians(latitude))", "cos_lat": "cos(radians(latitude))", "sin_lon": "sin(radians(longitude))", "cos_lon": "cos(radians(longitude))",
    "sin_day": f"sin(dayofyear(time) * {d(2 * math.pi / 365.25)})", "cos_day": f"cos(dayofyear(time) * {d(2 * math.pi / 365.25)})", "sin_hour": f"sin(hour(time) * {d(math.pi / 12)})", "cos_hour": f"cos(hour(time) * {d(math.pi / 12)})",
    "below": "CASE WHEN below_ground THEN 1.0 ELSE 0.0 END", "mask": "CASE WHEN valid THEN 1.0 ELSE 0.0 END",
}


@query("SF13", f"WITH {OBS} SELECT {LEVEL}, " + ", ".join(f"round(avg({v}), 6) AS {k}" for k, v in _F18.items()) + " FROM obs GROUP BY 1")
def feature_vector(spark, path):
    lat, lon, day, hour = F.radians("latitude"), F.radians("longitude"), F.dayofyear("time") * (2 * math.pi / 365.25), F.hour("time") * (math.pi / 12)
    features = {
        "t": F.col("temperature_k"), "q": F.col("q"), "h": F.col("height_m") / 10000, "n_dry": F.col("obs_dry"), "n_wet": F.col("obs_wet"), "n": F.col("obs_total"), "p": F.col(LEVEL) / 1000, "sp": F.col("surface_pressure_pa") / 100000,
        "sin_lat": F.sin(lat), "cos_lat": F.cos(lat), "sin_lon": F.sin(lon), "cos_lon": F.cos(lon), "sin_day": F.sin(day), "cos_day": F.cos(day), "sin_hour": F.sin(hour), "cos_hour": F.cos(hour),
        "below": F.col("below_ground").cast("double"), "mask": F.col("valid").cast("double"),
    }
    return by_level(observed(spark, path), *(r6(F.avg(v), k) for k, v in features.items()))


@query("SF15", f"WITH {PRED} SELECT {LEVEL}, round(avg(pow(error / sd, 2) / 2 + ln(sd) + {d(math.log(2 * math.pi) / 2)}), 6) AS nll FROM pred GROUP BY 1")
def gaussian_nll(spark, path):
    return by_level(predicted(spark, path), r6(F.avg(scores.nll(F.col("error"), F.col("sd"))), "nll"))


@query("SF17", f"WITH {PRED} SELECT {LEVEL}, round(avg({scores.crps_sql('error', f'greatest(sd, {d(1e-8)})')}), 6) AS crps, round(avg({scores.crps_sql('error', f'greatest(sd * 0, {d(1e-12)})')}), 6) AS floored FROM pred GROUP BY 1")
def gaussian_crps(spark, path):
    e, s = F.col("error"), F.col("sd")
    return by_level(predicted(spark, path), r6(F.avg(scores.crps(e, F.greatest(s, F.lit(1e-8)))), "crps"), r6(F.avg(scores.crps(e, F.greatest(s * 0, F.lit(1e-12)))), "floored"))


_Z = ", ".join(f"({d(k)}, {d(v)})" for k, v in scores.QUANTILES.items())


@query("SF18", f"WITH {PRED} SELECT {LEVEL}, " + ", ".join(f"round(avg(2 * sd * {d(z)}), 6) AS width_{int(k * 100)}, round(avg(2 * sd * {d(z)} + 2 / (1 - {d(k)}) * greatest(abs(error) - sd * {d(z)}, 0)), 6) AS score_{int(k * 100)}" for k, z in scores.QUANTILES.items()) + " FROM pred GROUP BY 1")
def interval_scores(spark, path):
    out = []
    for k in scores.QUANTILES:
        width, score = scores.interval_score(F.col("error"), F.col("sd"), k)
        out += [r6(F.avg(width), f"width_{int(k * 100)}"), r6(F.avg(score), f"score_{int(k * 100)}")]
    return by_level(predicted(spark, path), *out)


@query("SF19", f"WITH {PRED}, z(level, z) AS (VALUES {_Z}) SELECT level, round(z, 6) AS z, (SELECT count(*) FROM pred WHERE abs(error) <= sd * z.z) AS n_inside, (SELECT count(*) FROM pred) AS n FROM z")
def normal_quantiles(spark, path):
    one = predicted(spark, path).agg(F.count("*").alias("n"), *(F.count_if(F.abs("error") <= F.col("sd") * z).alias(f"n{i}") for i, z in enumerate(scores.QUANTILES.values())))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.lit(z).alias("z"), F.col(f"n{i}").alias("n_inside")) for i, (k, z) in enumerate(scores.QUANTILES.items()))))
    return one.select(rows.alias("r"), "n").select("r.level", r6("r.z", "z"), "r.n_inside", "n")


def chi_square(p: float, k: int) -> float:
    """The p quantile with k degrees of freedom, by halving."""

    def below(x: float) -> float:
        """Regularised lower incomplete gamma function at (k / 2, x / 2)."""
        a, x = k / 2, x / 2
        term = total = 1 / a
        n = 0
        while term > total * 1e-17:
            n += 1
            term *= x / (a + n)
            total += term
        return total * math.exp(a * math.log(x) - x - math.lgamma(a))

    low, high = 1e-12, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2


CHI = [(p, k, chi_square(p, k)) for p in (0.5, 0.68, 0.8, 0.9, 0.95, 0.99) for k in range(1, 7)]


@query("SF20", f"""WITH {PRED}, p AS (SELECT profile_no, count(*) AS k, sum(pow(error / sd, 2)) AS x FROM pred GROUP BY 1), c(level, k, most) AS (VALUES {", ".join(f"({d(p)}, {k}, {d(x)})" for p, k, x in CHI)})
SELECT level, CAST(c.k AS BIGINT) AS k, count(*) AS n, count(*) FILTER (x <= most) AS n_inside FROM p JOIN c ON c.k = p.k GROUP BY 1, 2""")
def joint_thresholds(spark, path):
    p = predicted(spark, path).groupBy("profile_no").agg(F.count("*").alias("k"), F.sum(F.pow(F.col("error") / F.col("sd"), F.lit(2))).alias("x"))
    c = spark.createDataFrame(CHI, "level double, k long, most double")  # 36 rows
    return p.join(F.broadcast(c), "k").groupBy("level", "k").agg(F.count("*").alias("n"), F.count_if(F.col("x") <= F.col("most")).alias("n_inside"))


@query("SF21", f"WITH {src.STATIONS_SQL} SELECT CASE WHEN latitude >= 30 THEN 'north' WHEN latitude <= -30 THEN 'south' ELSE 'tropics' END AS region, CASE WHEN abs(latitude) < 23.5 THEN 'tropics' WHEN abs(latitude) < 35 THEN 'subtropics' WHEN abs(latitude) < 60 THEN 'midlatitudes' ELSE 'polar' END AS band, count(*) AS n FROM stations GROUP BY ALL")
def regions(spark, path):
    return src.stations(spark, path).groupBy(geo.region(F.col("latitude")).alias("region"), geo.latitude_band(F.col("latitude")).alias("band")).agg(F.count("*").alias("n"))


@query("SF25", f"""WITH {src.STATIONS_SQL}, n AS (SELECT station_no, longitude, lead(longitude) OVER (ORDER BY station_no) - longitude AS step FROM stations),
x AS (SELECT station_no, longitude + (step + 180 - 360 * floor((step + 180) / 360) - 180) / 4 + 180 AS o FROM n WHERE step IS NOT NULL) SELECT station_no, round(o - 360 * floor(o / 360) - 180, 6) AS quarter FROM x""")
def circular_interpolation(spark, path):
    """A quarter of the way to the next station, the short way round. One sort of the station list."""
    step = F.lead("longitude").over(Window.orderBy("station_no")) - F.col("longitude")
    rows = src.stations(spark, path).withColumn("step", step).where("step IS NOT NULL")
    return rows.select("station_no", r6(geo.wrapped(F.col("longitude") + geo.wrapped(F.col("step")) / 4), "quarter"))


_P6 = f"((ln({d(600.0)}) - ln({d(700.0)})) / (ln({d(500.0)}) - ln({d(700.0)})))"


@query("SF26", f"""WITH {OBS}, w AS (SELECT profile_no, max(temperature_k) FILTER ({LEVEL} = 700) AS t7, max(temperature_k) FILTER ({LEVEL} = 500) AS t5, max(q) FILTER ({LEVEL} = 700) AS q7, max(q) FILTER ({LEVEL} = 500) AS q5 FROM obs WHERE valid GROUP BY 1)
SELECT profile_no, round(t7 + {_P6} * (t5 - t7), 6) AS t_600, CASE WHEN q7 > 0 AND q5 > 0 THEN round(1000 * exp(ln(q7) + {_P6} * (ln(q5) - ln(q7))), 6) END AS q_600 FROM w WHERE t7 IS NOT NULL AND t5 IS NOT NULL""")
def log_interpolation(spark, path):
    at = lambda c, p: F.max(F.when(F.col(LEVEL) == p, F.col(c)))
    w = observed(spark, path).where("valid").groupBy("profile_no").agg(at("temperature_k", 700).alias("t7"), at("temperature_k", 500).alias("t5"), at("q", 700).alias("q7"), at("q", 500).alias("q5"))
    f = (math.log(600) - math.log(700)) / (math.log(500) - math.log(700))
    q = F.when((F.col("q7") > 0) & (F.col("q5") > 0), 1000 * F.exp(F.log("q7") + f * (F.log("q5") - F.log("q7"))))
    return w.where("t7 IS NOT NULL AND t5 IS NOT NULL").select("profile_no", r6(F.col("t7") + f * (F.col("t5") - F.col("t7")), "t_600"), r6(q, "q_600"))


@query("SF27", f"WITH {OBS} SELECT {LEVEL}, round(avg(residual_total * (1 - greatest(0, least(1, tax * 14 - {d(0.1)})))), 6) AS dry, round(avg(residual_total * greatest(0, least(1, tax * 14 - {d(0.1)}))), 6) AS wet FROM obs WHERE valid GROUP BY 1")
def apportioned(spark, path):
    dry, wet = atmosphere.apportioned(F.col("residual_total"), F.col("tax") * 14 - 0.1)
    return by_level(observed(spark, path).where("valid"), r6(F.avg(dry), "dry"), r6(F.avg(wet), "wet"))


@query("SF28", "SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS month_key, strftime(o_orderdate, '%Y-%m') AS month, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, CAST(min(dayofyear(o_orderdate)) AS BIGINT) AS first_doy, count(*) AS n FROM orders GROUP BY 1, 2")
def date_parts(spark, path):
    t = F.col("o_orderdate")
    rows = src.table(spark, path, "orders", "o_orderdate").groupBy((F.year(t) * 100 + F.month(t)).cast("long").alias("month_key"), F.date_format(t, "yyyy-MM").alias("month"))
    return rows.agg(F.date_format(F.min(t), "yyyy-MM-dd").alias("first_day"), F.min(F.dayofyear(t)).cast("long").alias("first_doy"), F.count("*").alias("n"))


@query("SF29", "SELECT p_brand, upper(trim('  ' || p_type || ' ')) AS type, regexp_replace(p_brand, '#[0-9]+$', '') AS stem, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS number, string_agg(DISTINCT p_name, '; ' ORDER BY p_name) AS names, bool_and(regexp_matches(p_brand, '^Brand#[0-9]{2}$')) AS well_formed FROM part GROUP BY 1, 2, 3, 4")
def text_utilities(spark, path):
    b = F.col("p_brand")
    rows = src.table(spark, path, "part", "p_brand", "p_type", "p_name").groupBy("p_brand", F.upper(F.trim(F.concat(F.lit("  "), "p_type", F.lit(" ")))).alias("type"), F.regexp_replace(b, "#[0-9]+$", "").alias("stem"), F.regexp_extract(b, "([0-9]+)$", 1).cast("long").alias("number"))
    return rows.agg(F.array_join(F.sort_array(F.collect_set("p_name")), "; ").alias("names"), F.bool_and(b.rlike("^Brand#[0-9]{2}$")).alias("well_formed"))


@query("SF30", f"""WITH {PRED}, b AS (SELECT {LEVEL}, avg(residual_total) - stddev_pop(residual_total) AS low, avg(residual_total) + stddev_pop(residual_total) AS high FROM pred GROUP BY 1)
SELECT {LEVEL}, count(*) FILTER (3 * correction + tax * 50 - 2 < low OR 3 * correction + tax * 50 - 2 > high) AS n_clipped, round(avg(least(greatest(3 * correction + tax * 50 - 2, low), high)), 6) AS clipped FROM pred JOIN b USING ({LEVEL}) GROUP BY 1""")
def clipped(spark, path):
    rows = predicted(spark, path)
    r = F.col("residual_total")
    bounds = by_level(rows, (F.avg(r) - F.stddev_pop(r)).alias("low"), (F.avg(r) + F.stddev_pop(r)).alias("high"))  # six rows
    x = 3 * F.col("correction") + F.col("tax") * 50 - 2
    return by_level(rows.join(F.broadcast(bounds), LEVEL), F.count_if((x < F.col("low")) | (x > F.col("high"))).alias("n_clipped"), r6(F.avg(F.least(F.greatest(x, F.col("low")), F.col("high"))), "clipped"))


@query("SF31", f"WITH {PRED} SELECT {LEVEL}, round(avg(ln(greatest(abs(error), {d(0.05)}))), 6) AS log_scale, round(avg(exp(greatest(-5, least(4, 3 * ln(greatest(abs(error), {d(0.05)})))))), 6) AS inverse FROM pred GROUP BY 1")
def log_scale(spark, path):
    x = F.log(F.greatest(F.abs("error"), F.lit(0.05)))
    return by_level(predicted(spark, path), r6(F.avg(x), "log_scale"), r6(F.avg(F.exp(F.greatest(F.lit(-5.0), F.least(F.lit(4.0), 3 * x)))), "inverse"))


@query("SF32", f"WITH {PRED} SELECT {LEVEL}, round(100 * avg(abs(error) / greatest(abs(obs_total), {d(1e-8)})), 6) AS mape FROM pred GROUP BY 1")
def mape(spark, path):
    return by_level(predicted(spark, path), r6(100 * F.avg(F.abs("error") / F.greatest(F.abs("obs_total"), F.lit(1e-8))), "mape"))


@query("PF1", f"WITH {src.LEVELS_SQL} SELECT profile_no, {LEVEL}, round(height_m, 6) AS height_m FROM lv WHERE station_no = 7")
def preferred_columns(spark, path):
    rows = src.levels(spark, path).where("station_no = 7").withColumn("height_m", F.round("height_m", 6))
    return rows.select(*(c for c in ("profile_no", "platform", LEVEL, "height_m", "vertical_velocity") if c in rows.columns))


@query("PF4", f"""WITH {src.LEVELS_SQL}, r AS (SELECT CASE WHEN TRY_CAST(nullif(pressure_flag, 'N') AS VARCHAR) IS NULL THEN 'no_flag' WHEN tax > {d(0.07)} THEN 'bad_value' WHEN profile_no % 13 = 0 THEN 'bad_surface' ELSE 'retained' END AS reason FROM lv) SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def attribute_filter(spark, path):
    reason = F.when(F.col("pressure_flag") == "N", "no_flag").when(F.col("tax") > 0.07, "bad_value").when(F.col("profile_no") % 13 == 0, "bad_surface").otherwise("retained")
    return src.levels(spark, path).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("PF5", f"WITH {src.LEVELS_SQL} SELECT {LEVEL}, count(*) FILTER (isfinite(height_m) AND height_m BETWEEN 0 AND 9180 AND isfinite(temperature_k) AND temperature_k BETWEEN 200 AND 300 AND latitude BETWEEN -70 AND 70 AND longitude BETWEEN -180 AND 180) AS n_valid, count(*) AS n FROM lv GROUP BY 1")
def native_validity(spark, path):
    number = lambda c: ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) != float("inf"))
    ok = number("height_m") & F.col("height_m").between(0, 9180) & number("temperature_k") & F.col("temperature_k").between(200, 300) & F.col("latitude").between(-70, 70) & F.col("longitude").between(-180, 180)
    return by_level(src.levels(spark, path), F.count_if(ok).alias("n_valid"), F.count("*").alias("n"))


_MASK = "valid AND NOT below_ground AND isfinite(obs_total) AND isfinite(bg_total) AND height_m > elevation_m AND height_m BETWEEN low AND high AND tax * tax >= 0 AND q >= 0"


@query("PF11", f"""WITH {OBS}, s AS (SELECT profile_no, min(height_m) AS low, max(height_m) AS high FROM obs WHERE valid GROUP BY 1) SELECT {LEVEL}, count(*) FILTER ({_MASK}) AS n_scored, count(*) AS n FROM obs LEFT JOIN s USING (profile_no) GROUP BY 1""")
def height_mask(spark, path):
    """Support is the range of valid heights of the profile itself, by a window over its few levels."""
    by = Window.partitionBy("profile_no")
    h = F.col("height_m")
    rows = observed(spark, path).withColumn("low", F.min(F.when(F.col("valid"), h)).over(by)).withColumn("high", F.max(F.when(F.col("valid"), h)).over(by))
    number = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    ok = F.col("valid") & ~F.col("below_ground") & number("obs_total") & number("bg_total") & (h > F.col("elevation_m")) & h.between(F.col("low"), F.col("high")) & (F.col("tax") * F.col("tax") >= 0) & (F.col("q") >= 0)
    return by_level(rows, F.count_if(ok).alias("n_scored"), F.count("*").alias("n"))


@query("PF20", """WITH p AS (SELECT c_custkey, regexp_replace(upper(trim('b''' || lower(c_mktsegment) || ' ''')), '^B''(.*)''$', '\\1') AS platform, c_custkey % 3 <> 0 AS main, c_custkey % 5 = 0 AS live FROM customer)
SELECT trim(platform) AS platform, count(*) AS n FROM p WHERE trim(platform) IN ('FURNITURE', 'BUILDING', 'MACHINERY') AND main AND NOT live GROUP BY 1""")
def platforms(spark, path):
    text = F.concat(F.lit("b'"), F.lower("c_mktsegment"), F.lit(" '"))
    rows = src.table(spark, path, "customer", "c_custkey", "c_mktsegment").withColumn("platform", F.trim(F.regexp_replace(F.upper(F.trim(text)), "^B'(.*)'$", "$1")))
    allowed = spark.createDataFrame([(p,) for p in ("FURNITURE", "BUILDING", "MACHINERY")], "platform string")
    return rows.where("c_custkey % 3 <> 0 AND NOT (c_custkey % 5 = 0)").join(F.broadcast(allowed), "platform", "left_semi").groupBy("platform").agg(F.count("*").alias("n"))


@query("PF23", """WITH t AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'True' WHEN 'O' THEN '0' ELSE 'maybe' END AS x FROM orders) SELECT CASE lower(x) WHEN '1' THEN true WHEN 'true' THEN true WHEN '0' THEN false WHEN 'false' THEN false END AS value, count(*) AS n, count(*) FILTER (lower(x) NOT IN ('0', '1', 'true', 'false')) AS n_bad FROM t GROUP BY 1""")
def strict_boolean(spark, path):
    s = F.col("o_orderstatus")
    x = F.lower(F.when(s == "F", "True").when(s == "O", "0").otherwise("maybe"))
    value = F.when(x.isin("1", "true"), True).when(x.isin("0", "false"), False)
    return src.table(spark, path, "orders", "o_orderstatus").groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.count_if(~x.isin("0", "1", "true", "false")).alias("n_bad"))


@query("PF24", f"""WITH {VALID}, p AS (SELECT profile_no, min(line_no * 1000 + dewpoint_depression_c) % 1000 AS first_value, quantile_cont(dewpoint_depression_c, 0.5) AS middle, quantile_cont(height_m, 0.5) FILTER (valid) AS height FROM lvv GROUP BY 1)
SELECT profile_no, round(first_value, 6) AS first_value, round(middle, 6) AS middle, round(coalesce(height, -1), 6) AS height FROM p""")
def profile_scalar(spark, path):
    v = F.col("dewpoint_depression_c")
    rows = valid(spark, path).groupBy("profile_no")
    return rows.agg(r6(F.min(F.col("line_no") * 1000 + v) % 1000, "first_value"), r6(F.median(v), "middle"), r6(F.coalesce(F.median(F.when(F.col("valid"), F.col("height_m"))), F.lit(-1.0)), "height"))


@query("WN6", f"""WITH {src.SERIES_SQL}, w AS (SELECT station, count(*) OVER f AS n, max(CASE WHEN value > 180 THEN 1 ELSE 0 END) OVER f AS hit, max(CASE WHEN value > 180 THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS later FROM series WINDOW f AS (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT station, count(*) AS n_windows, count(*) FILTER (hit = 0 AND coalesce(later, 0) = 0) AS n_kept FROM w WHERE n = 5 GROUP BY 1""")
def blocked_windows(spark, path):
    by = Window.partitionBy("station").orderBy("ts", "event_id")
    flag = (F.col("value") > 180).cast("int")
    rows = src.series(spark, path).select("station", F.count("*").over(by.rowsBetween(-4, 0)).alias("n"), F.max(flag).over(by.rowsBetween(-4, 0)).alias("hit"), F.max(flag).over(by.rowsBetween(1, 3)).alias("later"))
    return rows.where("n = 5").groupBy("station").agg(F.count("*").alias("n_windows"), F.count_if((F.col("hit") == 0) & (F.coalesce("later", F.lit(0)) == 0)).alias("n_kept"))


@query("WN7", f"""WITH {src.SERIES_SQL}, f AS (SELECT value AS p, unnest([1, 2, 4]) AS h, unnest([lead(value, 1) OVER w, lead(value, 2) OVER w, lead(value, 4) OVER w]) AS y FROM series WINDOW w AS (PARTITION BY station ORDER BY ts, event_id))
SELECT CAST(h AS BIGINT) AS horizon, count(y) AS n, round(sqrt(avg(pow(p - y, 2))), 6) AS rmse FROM f GROUP BY 1""")
def persistence(spark, path):
    by = Window.partitionBy("station").orderBy("ts", "event_id")
    pairs = F.array(*(F.struct(F.lit(h).cast("long").alias("horizon"), F.lead("value", h).over(by).alias("y")) for h in (1, 2, 4)))
    rows = src.series(spark, path).select("value", pairs.alias("ps")).select("value", F.explode("ps").alias("p")).select("value", "p.*")
    return rows.groupBy("horizon").agg(F.count("y").alias("n"), r6(F.sqrt(F.avg(F.pow(F.col("value") - F.col("y"), F.lit(2)))), "rmse"))


@query("WN14", f"""WITH {OBS}, e AS (SELECT {LEVEL}, avg(residual_total) AS x FROM obs WHERE valid GROUP BY 1) SELECT {LEVEL}, round(max(x) OVER (ORDER BY {LEVEL} DESC ROWS UNBOUNDED PRECEDING), 6) AS edge FROM e""")
def monotone_edges(spark, path):
    edges = by_level(observed(spark, path).where("valid"), F.avg("residual_total").alias("x"))  # six rows
    return edges.select(LEVEL, r6(F.max("x").over(Window.orderBy(F.desc(LEVEL)).rowsBetween(Window.unboundedPreceding, 0)), "edge"))


@query("WN15", f"WITH {src.LEVELS_SQL}, n AS (SELECT station_no, count(*) AS n FROM lv GROUP BY 1 HAVING count(*) >= 10) SELECT station_no, n, CAST(row_number() OVER (ORDER BY n DESC, station_no) AS BIGINT) AS selection_rank FROM n")
def selection_rank(spark, path):
    rows = src.levels(spark, path).groupBy("station_no").agg(F.count("*").alias("n")).where("n >= 10")  # stations
    return rows.select("station_no", "n", F.row_number().over(Window.orderBy(F.desc("n"), "station_no")).cast("long").alias("selection_rank"))


@query("WN17", f"""WITH {OBS}, s AS (SELECT profile_no, {LEVEL}, height_m AS x_lo, temperature_k AS y_lo, lead(height_m) OVER w AS x_hi, lead(temperature_k) OVER w AS y_hi FROM obs WHERE valid WINDOW w AS (PARTITION BY profile_no ORDER BY height_m, {LEVEL} DESC))
SELECT profile_no, {LEVEL}, round(x_lo, 6) AS x_lo, round(y_lo, 6) AS y_lo, round(x_hi, 6) AS x_hi, round(y_hi, 6) AS y_hi FROM s WHERE x_hi IS NOT NULL""")
def bracket_segments(spark, path):
    rows = profiles.steps(observed(spark, path), "temperature_k", "height_m")
    return rows.select("profile_no", LEVEL, *(r6(c, c) for c in ("x_lo", "y_lo", "x_hi", "y_hi")))


@query("SL1", f"""WITH {OBS} SELECT profile_no, string_agg(CAST({LEVEL} AS VARCHAR), ',' ORDER BY array_position([500, 1000, 300, 925, 850, 700], {LEVEL})) AS in_order FROM obs GROUP BY 1""")
def canonical_sort(spark, path):
    order = F.array(*(F.lit(p) for p in (500, 1000, 300, 925, 850, 700)))
    key = F.struct(F.array_position(order, F.col(LEVEL)).alias("k"), F.col(LEVEL).cast("string").alias("p"))
    return observed(spark, path).groupBy("profile_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda s: s["p"]), ",").alias("in_order"))


@query("SL7", f"""WITH {src.STATIONS_SQL}, p AS (SELECT a.station_no AS target, b.station_no AS other, round(2 * {d(6371.0088)} * asin(least(1, sqrt(pow(sin((radians(b.latitude) - radians(a.latitude)) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))), 6) AS km FROM stations a JOIN stations b ON a.station_no <> b.station_no)
SELECT target, round(sum(km), 4) AS km_of_4 FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY target ORDER BY km, other) <= 4) GROUP BY 1""")
def smallest_distances(spark, path):
    """Stations are 120 at most, so their pairs are few."""
    from aerolith.operators import spatial

    s = src.stations(spark, path)
    near = spatial.neighbours(s, s, "station_no", 4)
    return near.groupBy("target").agg(F.round(F.sum(F.round("km", 6)), 4).alias("km_of_4"))


@query("SO5", f"""WITH {src.LEVELS_SQL}, v AS (SELECT 'A' AS variant, latitude, longitude FROM lv UNION ALL SELECT 'B', latitude + {d(0.1)}, longitude FROM lv UNION ALL SELECT 'C', round(latitude, 0), round(longitude, -1) FROM lv) SELECT variant, count(*) AS n, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude FROM v GROUP BY 1""")
def variants(spark, path):
    """Three definitions of the coordinates of the same rows, exploded in one pass."""
    a, o = F.col("latitude"), F.col("longitude")
    one = lambda name, lat, lon: F.struct(F.lit(name).alias("variant"), lat.alias("latitude"), lon.alias("longitude"))
    rows = src.levels(spark, path).select(F.explode(F.array(one("A", a, o), one("B", a + 0.1, o), one("C", F.round(a, 0), F.round(o, -1)))).alias("v")).select("v.*")
    return rows.groupBy("variant").agg(F.count("*").alias("n"), r6(F.avg("latitude"), "latitude"), r6(F.avg("longitude"), "longitude"))
