"""Profile probability, interpolation in four dimensions, neighbours of profiles, selection of models and reports as batches, each with its SQL."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolith.functions import feature_sets, geo
from aerolith.operators import spatial
from aerolith.plans import fields, soundings
from aerolith.plans.formulas import CHI, LEVEL
from aerolith.plans.inference import ensemble_weight
from aerolith.plans.registry import d, r6, registry
from aerolith.plans.soundings import CAL, DEV, OBS, PRED, observed, predicted
from aerolith.sources import levels as src
from aerolith.sources import text
from aerolith.streaming import series as streams
from aerolith.streaming import state

Q, SQL, query = registry()
#: Correlation of neighbouring levels in the queries; it falls by this factor a level.
RHO = 0.6
_I = "list_position([1000, 925, 850, 700, 500, 300], pressure_hpa)"


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


# Profile probability


def precisions(spark: SparkSession, correlation: np.ndarray) -> DataFrame:
    """bits, lndet, a: for each of the 63 sets of levels, the inverse of their correlations (36 numbers, 0 outside the set) and the logarithm of its determinant."""
    rows = []
    for k in range(1, 7):
        for some in combinations(range(6), k):
            part = correlation[np.ix_(some, some)]
            if np.linalg.eigvalsh(part)[0] <= 1e-8:
                raise ValueError(f"correlations of levels {some} are not positive definite")
            a = np.zeros((6, 6))
            a[np.ix_(some, some)] = np.linalg.inv(part)
            rows.append((sum(1 << i for i in some), float(np.linalg.slogdet(part)[1]), a.ravel().tolist()))
    return spark.createDataFrame(rows, "bits long, lndet double, a array<double>")


def joint_scores(rows: DataFrame, correlation: np.ndarray) -> DataFrame:
    """profile_no, k, distance (squared Mahalanobis), nll of rows (profile_no, pressure_hpa, error, sd): one aggregation by profile, 63 rows broadcast."""
    u = F.col("error") / F.col("sd")
    at = [F.col(LEVEL) == p for p in src.LEVELS]
    wide = rows.groupBy("profile_no").agg(
        F.count("*").alias("k"), F.sum(F.log("sd")).alias("spread"), *(F.coalesce(F.max(F.when(c, u)), F.lit(0.0)).alias(f"u{i}") for i, c in enumerate(at)),
        sum((F.max(F.when(c, F.lit(1 << i)).otherwise(0)) for i, c in enumerate(at)), F.lit(0)).cast("long").alias("bits"),
    )
    both = wide.join(F.broadcast(precisions(rows.sparkSession, correlation)), "bits")
    q = sum((F.col("a")[6 * i + j] * F.col(f"u{i}") * F.col(f"u{j}") for i in range(6) for j in range(6)), F.lit(0.0))
    both = both.withColumn("distance", q)
    return both.select("profile_no", "k", "distance", (0.5 * (F.col("k") * math.log(2 * math.pi) + F.col("lndet") + F.col("distance")) + F.col("spread")).alias("nll"))


#: The twin takes each level given the one before it, which is the same law where correlations fall by a factor a level.
_MARKOV = f"""{PRED}, u AS (SELECT profile_no, ln(sd) AS s, error / sd AS u, {_I} AS i FROM pred),
m AS (SELECT *, lag(u) OVER w AS u0, i - lag(i) OVER w AS g FROM u WINDOW w AS (PARTITION BY profile_no ORDER BY i)),
v AS (SELECT profile_no, s, u - coalesce(pow({d(RHO)}, g) * u0, 0) AS e, 1 - coalesce(pow({d(RHO)}, 2 * g), 0) AS v FROM m),
j AS (SELECT profile_no, count(*) AS k, sum(e * e / v) AS distance, sum(0.5 * ({d(math.log(2 * math.pi))} + ln(v) + e * e / v) + s) AS nll FROM v GROUP BY 1),
c(k, most) AS (VALUES {", ".join(f"({k}, {d(x)})" for p, k, x in CHI if p == 0.9)})"""


def falling() -> np.ndarray:
    i = np.arange(6)
    return RHO ** np.abs(i[:, None] - i)


@query("AR8", f"WITH {_MARKOV} SELECT k, count(*) AS n, round(avg(nll), 6) AS nll, round(avg(nll / k), 6) AS nll_per_level, round(avg(distance), 6) AS distance, count(*) FILTER (distance <= most) AS n_inside FROM j JOIN c USING (k) GROUP BY 1")
def joint_likelihood(spark, path):
    inside = F.when(F.lit(False), 0.0)
    for p, k, x in CHI:
        inside = inside.when(F.col("k") == k, x) if p == 0.9 else inside
    rows = joint_scores(predicted(spark, path), falling())
    return rows.groupBy("k").agg(F.count("*").alias("n"), r6(F.avg("nll"), "nll"), r6(F.avg(F.col("nll") / F.col("k")), "nll_per_level"), r6(F.avg("distance"), "distance"), F.count_if(F.col("distance") <= inside).alias("n_inside"))


def floored(r: np.ndarray, least: float = 1e-5) -> np.ndarray:
    """The symmetric part with eigenvalues of at least the floor and ones on the diagonal; itself if it has them."""
    r = (r + r.T) / 2
    values, vectors = np.linalg.eigh(r)
    if values[0] < least:
        r = (vectors * np.maximum(values, least)) @ vectors.T
    scale = np.sqrt(np.diag(r))
    return r / np.outer(scale, scale)


@query("AR7", f"""WITH {OBS}, v AS (SELECT profile_no, pressure_hpa, residual_total AS r FROM obs WHERE valid)
SELECT a.pressure_hpa AS level_a, b.pressure_hpa AS level_b, round(CASE WHEN a.pressure_hpa = b.pressure_hpa THEN 1 WHEN count(*) < 30 THEN 0 ELSE corr(a.r, b.r) END, 5) AS r FROM v a JOIN v b ON a.profile_no = b.profile_no GROUP BY 1, 2""")
def final_correlation(spark, path):
    """The 21 pairs of AG24 come to the driver, whatever the number of profiles."""
    at = {p: i for i, p in enumerate(src.LEVELS)}
    r = np.eye(6)
    for row in soundings.level_correlation(spark, path).collect():
        if row.level_a != row.level_b:
            r[at[row.level_a], at[row.level_b]] = r[at[row.level_b], at[row.level_a]] = row.r
    r = floored(r)
    precisions(spark, r)  # raises if some set of levels is singular
    return spark.createDataFrame([(a, b, float(r[i, j])) for a, i in at.items() for b, j in at.items()], "level_a int, level_b int, r double").withColumn("r", F.round("r", 5))


def _normal_sql(key: str) -> str:
    u = lambda start: f"((CAST('0x' || substr(md5({key}), {start}, 8) AS BIGINT) + {d(0.5)}) / {d(4294967296.0)})"
    return f"sqrt(-2 * ln({u(1)})) * cos({d(2 * math.pi)} * {u(9)})"


#: Draws of the energy score.
DRAWS = 64


@query("AR10", f"""WITH {PRED}, z AS (SELECT profile_no, {LEVEL}, error, sd, x, {_normal_sql(f"profile_no || ':' || {LEVEL} || ':' || x")} AS z FROM pred, range({DRAWS}) r(x)),
s AS (SELECT a.profile_no, a.x, count(*) AS k, sqrt(sum(pow(a.error + a.sd * a.z, 2))) AS off, sqrt(sum(pow(a.sd * (a.z - b.z), 2))) AS apart FROM z a JOIN z b ON a.profile_no = b.profile_no AND a.{LEVEL} = b.{LEVEL} AND b.x = (a.x + 1) % {DRAWS} GROUP BY 1, 2),
p AS (SELECT profile_no, any_value(k) AS k, avg(off) - avg(apart) / 2 AS score FROM s GROUP BY 1) SELECT k, count(*) AS n, round(avg(score), 6) AS energy FROM p GROUP BY 1""")
def energy_score(spark, path):
    """E|X - y| - E|X - X'| / 2 with draws that are hashes of profile, level and number; X' is the draw after X.

    A profile's levels, six at most, come together in one row before it draws; draws are added up within that row, so
    what is shuffled are levels, not draws.
    """
    ls = predicted(spark, path).groupBy("profile_no").agg(F.collect_list(F.struct(LEVEL, "error", "sd")).alias("ls"))
    rows = ls.select("profile_no", *(F.col(f"ls.{c}").cast(f"array<{kind}>").alias(c) for c, kind in ((LEVEL, "string"), ("error", "double"), ("sd", "double"))))
    scores = rows.mapInArrow(_energies, "k long, score double")
    return scores.groupBy("k").agg(F.count("*").alias("n"), r6(F.avg("score"), "energy"))


def _energies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, score of profiles with lists of their levels. A draw is the standard normal that _normal_sql makes of the md5 digest of profile, level and number; nulls add nothing."""
    ends = [b":%d" % x for x in range(DRAWS)]
    for whole in batches:
        for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
            no, levels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keys = [f"{n}:{p}".encode() for n, ps in zip(no, levels, strict=True) for p in ps]
            digests = b"".join([hashlib.md5(k + x, usedforsecurity=False).digest() for k in keys for x in ends])
            u = (np.frombuffer(digests, ">u4").reshape(len(keys), DRAWS, 4)[..., :2] + 0.5) / 4294967296.0
            z = np.sqrt(-2 * np.log(u[..., 0])) * np.cos(2 * math.pi * u[..., 1])
            error, sd = (batch.column(c).flatten().to_numpy(zero_copy_only=False)[:, None] for c in (2, 3))
            k = np.array([len(ps) for ps in levels])
            first = np.concatenate([[0], k.cumsum()[:-1]])
            norm = lambda x: np.where(np.add.reduceat(~np.isnan(x), first, dtype=np.int64) > 0, np.sqrt(np.add.reduceat(np.nan_to_num(x) ** 2, first)), np.nan).mean(1)  # noqa: B023, E731
            score = norm(error + sd * z) - norm(sd * (z - np.roll(z, -1, 1))) / 2
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(score, from_pandas=True)], ["k", "score"])


@query("ML7", f"""WITH {PRED}, s AS (SELECT {LEVEL}, sqrt(avg(pow(correction_dry - residual_dry, 2))) AS sd_dry, sqrt(avg(pow(correction_wet - residual_wet, 2))) AS sd_wet, sqrt(avg(error * error)) AS sd_total FROM pred WHERE time >= TIMESTAMP '{DEV}' AND time < TIMESTAMP '{CAL}' GROUP BY 1),
p AS (SELECT profile_no, bg_total + correction AS mean, sd_dry, sd_wet, sd_total, {_I} AS i FROM pred JOIN s USING ({LEVEL}) WHERE time >= TIMESTAMP '{CAL}'),
v AS (SELECT a.profile_no, sum(a.sd_total * b.sd_total * pow({d(RHO)}, abs(a.i - b.i))) AS v FROM p a JOIN p b ON a.profile_no = b.profile_no GROUP BY 1)
SELECT profile_no, CAST(sum(1 << (i - 1)) AS BIGINT) AS mask_bits, round(sum(mean), 4) AS mean_sum, round(sum(sd_dry), 6) AS sd_dry, round(sum(sd_wet), 6) AS sd_wet, round(any_value(v), 4) AS variance_of_sum FROM p JOIN v USING (profile_no) GROUP BY 1""")
def probabilistic_prediction(spark, path):
    """Mean, spread by component and covariance over the levels of a profile; spreads by level are six rows, covariances stay within the profile's own row."""
    rows = predicted(spark, path)
    rms = lambda e, name: F.sqrt(F.avg(e * e)).alias(name)
    old = rows.where((F.col("time") >= _at(DEV)) & (F.col("time") < _at(CAL)))
    s = old.groupBy(LEVEL).agg(rms(F.col("correction_dry") - F.col("residual_dry"), "sd_dry"), rms(F.col("correction_wet") - F.col("residual_wet"), "sd_wet"), rms(F.col("error"), "sd_total"))
    new = rows.where(F.col("time") >= _at(CAL)).drop("sd").join(F.broadcast(s), LEVEL)
    at = [F.col(LEVEL) == p for p in src.LEVELS]
    wide = new.groupBy("profile_no").agg(
        sum((F.max(F.when(c, F.lit(1 << i)).otherwise(0)) for i, c in enumerate(at)), F.lit(0)).cast("long").alias("mask_bits"), F.round(F.sum(F.col("bg_total") + F.col("correction")), 4).alias("mean_sum"),
        r6(F.sum("sd_dry"), "sd_dry"), r6(F.sum("sd_wet"), "sd_wet"), *(F.coalesce(F.max(F.when(c, F.col("sd_total"))), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(at)),
    )
    r = falling()
    v = sum((float(r[i, j]) * F.col(f"s{i}") * F.col(f"s{j}") for i in range(6) for j in range(6)), F.lit(0.0))
    return wide.select("profile_no", "mask_bits", "mean_sum", "sd_dry", "sd_wet", F.round(v, 4).alias("variance_of_sum"))


# Fields and neighbours


def _cells_sql(points: str) -> str:
    """id, t, a, o, w of points (id, t, lat, lon)."""
    return f"""ya AS (SELECT *, greatest(0, least(6, (90 - lat) / {d(30.0)})) AS y, lon / {d(30.0)} AS x FROM {points}),
za AS (SELECT *, least(CAST(floor(y) AS BIGINT), 5) AS a0, CAST(floor(x) AS BIGINT) % 12 AS o0, y - least(floor(y), 5) AS fy, x - floor(x) AS fx FROM ya),
cells AS (SELECT id, t, a0 + da AS a, (o0 + do_) % 12 AS o, CASE da WHEN 1 THEN fy ELSE 1 - fy END * CASE do_ WHEN 1 THEN fx ELSE 1 - fx END AS w FROM za, (VALUES (0), (1)) p(da), (VALUES (0), (1)) q(do_))"""


@query("JN7", f"""WITH {src.TARGETS_SQL}, pts AS (SELECT id, lat, lon, tpos AS t FROM targets), {_cells_sql('pts')},
g4 AS (SELECT t, l, a, o, ((t * 7 + a * 13 + o * 29 + l * 17) % 101) * {d(0.1)} AS v FROM range(125) x(t), range(4) q(l), range(7) y(a), range(12) z(o)),
e AS (SELECT id, a, o, CAST(floor(t) AS BIGINT) + dt AS t, CAST(floor(lpos) AS BIGINT) + dl AS l, w * CASE dt WHEN 1 THEN t - floor(t) ELSE 1 - (t - floor(t)) END * CASE dl WHEN 1 THEN lpos - floor(lpos) ELSE 1 - (lpos - floor(lpos)) END AS w
  FROM (SELECT *, (id % 40) / {d(10.0)} AS lpos FROM cells), (VALUES (0), (1)) p(dt), (VALUES (0), (1)) q(dl))
SELECT id, CASE WHEN sum(w) FILTER (v IS NOT NULL) > 1 - 1e-9 THEN round(sum(w * v), 6) END AS value FROM e LEFT JOIN g4 USING (t, l, a, o) WHERE w > 0 GROUP BY 1""")
def four_dimensions(spark, path):
    """Sixteen weighted cells a point; where a cell that counts is not in the field there is no value."""
    grid = src.grid(spark).crossJoin(F.broadcast(spark.range(4).withColumnRenamed("id", "l")))  # the field itself: four levels
    grid = grid.select("t", "l", "a", "o", (((F.col("t") * 7 + F.col("a") * 13 + F.col("o") * 29 + F.col("l") * 17) % 101) * F.lit(0.1)).alias("v"))
    points = src.targets(spark, path).withColumn("lpos", (F.col("id") % 40) / 10.0)

    def ends(of: str) -> Column:
        low, f = F.floor(of), F.col(of) - F.floor(of)
        return F.array(F.struct(low.alias("at"), (1 - f).alias("w")), F.struct((low + 1).alias("at"), f.alias("w")))

    e = points.select("id", "lpos", "lat", "lon", F.explode(ends("tpos")).alias("x")).select("id", "lat", "lon", "x", F.explode(ends("lpos")).alias("y"))
    e = e.select("id", "x", "y", F.explode(spatial.corners(F.col("lat"), F.col("lon"))).alias("c"))
    e = e.select("id", F.col("x.at").alias("t"), F.col("y.at").alias("l"), "c.a", "c.o", (F.col("c.w") * F.col("x.w") * F.col("y.w")).alias("w")).where("w > 0")
    found = F.sum(F.when(F.col("v").isNotNull(), F.col("w")))
    return e.join(grid, ["t", "l", "a", "o"], "left").groupBy("id").agg(F.when(found > 1 - 1e-9, F.round(F.sum(F.col("w") * F.col("v")), 6)).alias("value"))


_LATTICE = f"pts AS (SELECT (i * 18 + j) AS id, t, -80 + i * {d(20.0)} AS lat, 10 + j * {d(20.0)} AS lon FROM (SELECT DISTINCT t FROM field), range(9) x(i), range(18) y(j))"


@query("JN25", f"WITH {src.FIELD_SQL}, {_LATTICE}, {_cells_sql('pts')} SELECT cells.t, id, round(sum(w * v), 6) AS value FROM cells JOIN field USING (t, a, o) GROUP BY ALL HAVING count(*) = 4")
def regrid(spark, path):
    """The other grid's cells are points, at each time that the field has; a point has a value where all four cells around it do."""
    field = src.field(spark, path)
    points = field.select("t").distinct().select("t", F.explode(F.sequence(F.lit(0), F.lit(161))).alias("id"))
    points = points.select("t", "id", (F.lit(-80.0) + F.floor(F.col("id") / 18) * 20.0).alias("lat"), (F.lit(10.0) + F.col("id") % 18 * 20.0).alias("lon"))
    cells = points.select("id", "t", F.explode(spatial.corners(F.col("lat"), F.col("lon"))).alias("c")).select("id", "t", "c.*")
    found = cells.join(field, ["t", "a", "o"]).groupBy("t", "id").agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("v")).alias("value")).where("n = 4")
    return found.select("t", F.col("id").cast("long").alias("id"), r6("value", "value"))


@query("SC6", f"WITH {src.FIELD_SQL} SELECT t, 6 - a AS i_lat, (o + 6) % 12 AS i_lon, CAST(90 - 30 * a AS DOUBLE) AS latitude, CAST((o * 30 + 180) % 360 - 180 AS DOUBLE) AS longitude, round(v, 6) AS value FROM field")
def field_as_table(spark, path):
    """A field that arrives as one array of rows a time becomes rows: names resolved, longitudes from -180, coordinates ascending, cells without a value left out."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(83)), lambda k: F.element_at(F.map_from_entries(F.collect_list(F.struct((F.col("a") * 12 + F.col("o")).cast("int").alias("k"), "v"))), k))
    arrays = src.field(spark, path).groupBy(F.col("t").alias("valid_time")).agg(cells.alias("refractivity"))  # 84 cells a time
    names = {"valid_time": "t", "refractivity": "v"}
    rows = arrays.withColumnsRenamed({k: v for k, v in names.items() if k in arrays.columns}).select("t", F.posexplode("v").alias("k", "value")).where("value IS NOT NULL")
    a, o = F.floor(F.col("k") / 12), F.col("k") % 12
    return rows.select(
        "t", (6 - a).cast("long").alias("i_lat"), ((o + 6) % 12).cast("long").alias("i_lon"), (90 - 30 * a).cast("double").alias("latitude"), geo.wrapped(o * 30).cast("double").alias("longitude"), r6("value", "value")
    )


_BEARING = "degrees(atan2(sin(radians(b.longitude - a.longitude)) * cos(radians(b.latitude)), cos(radians(a.latitude)) * sin(radians(b.latitude)) - sin(radians(a.latitude)) * cos(radians(b.latitude)) * cos(radians(b.longitude - a.longitude)))) + 360"
_REACH = f"{src.STATIONS_SQL}, reach AS (SELECT a.station_no, b.station_no AS other, {fields._KM} AS km, {_BEARING} AS x FROM stations a JOIN stations b ON a.station_no <> b.station_no)"
_NEAR = f"""{_REACH}, {src.LEVELS_SQL}, pr AS (SELECT DISTINCT profile_no, station_no, time, latitude FROM lv), nb AS (SELECT a.profile_no, b.profile_no AS neighbour, km, x - 360 * floor(x / 360) AS bearing,
  row_number() OVER (PARTITION BY a.profile_no ORDER BY round(km, 6), b.profile_no) AS rank, b.latitude - a.latitude AS dlat FROM pr a JOIN reach USING (station_no) JOIN pr b ON b.station_no = other AND b.time = a.time WHERE km <= 5000)"""


def profile_neighbours(spark, path, most: int = 3, within_km: float = 5000.0) -> DataFrame:
    """profile_no, neighbour, rank, km, bearing, dlat: the nearest profiles of other stations at the same time."""
    p = src.levels(spark, path).select("profile_no", "station_no", "time", "latitude", "longitude").distinct()
    near = spatial.nearest(p, p, "profile_no", most, ("time",), "station_no", within_km)
    return near.select(F.col("target").alias("profile_no"), "neighbour", F.col("rank").cast("long").alias("rank"), "km", "bearing", (F.col("lat_b") - F.col("latitude")).alias("dlat"))


@query("JN12", f"WITH {_NEAR} SELECT profile_no, neighbour, rank, round(km, 6) AS km, round(bearing, 5) AS bearing FROM nb WHERE rank <= 3")
def nearest_profiles(spark, path):
    """A top-k report: the limit is what the operator is for."""
    return profile_neighbours(spark, path).select("profile_no", "neighbour", "rank", r6("km", "km"), F.round("bearing", 5).alias("bearing"))


#: Levels of the context tensor; neighbours that are looked at, and that stay.
_TENSOR, _LOOKED, _SLOTS = (850, 700, 500), 6, 3
_T = 2 * math.pi
_WIDE = ", ".join(f"max({c}) FILTER ({LEVEL} = {p}) AS {k}_{p}" for p in _TENSOR for k, c in (("n", "bg_total"), ("h", "height_m / 1000.0"), ("r", "residual_total"), ("c", "correction")))
_SCALE = ", ".join(f"avg({k}_{p}) AS m{k}_{p}, stddev_pop({k}_{p}) AS s{k}_{p}" for p in _TENSOR for k in "nhr")
_PLACE_SQL = ("latitude / 90", "sin(radians(longitude))", "cos(radians(longitude))", f"sin(dayofyear(time) * {d(_T)} / 366)", f"cos(dayofyear(time) * {d(_T)} / 366)", f"sin(hour(time) * {d(_T)} / 24)", f"cos(hour(time) * {d(_T)} / 24)")
_OWN_SQL = [
    *(f"(n_{p} - mn_{p}) / sn_{p}" for p in _TENSOR), *(f"(h_{p} - mh_{p}) / sh_{p}" for p in _TENSOR), *(f"(c_{p} - mr_{p}) / sr_{p}" for p in _TENSOR), *_PLACE_SQL, *(f"(r_{p} - c_{p} - mr_{p}) / sr_{p}" for p in _TENSOR),
]
_PAIR_SQL = ["ln(1 + km / 100)", "sin(radians(bearing))", "cos(radians(bearing))", *(f"(b.n_{p} - a.n_{p}) / a.sn_{p}" for p in _TENSOR)]
_BLOCK_SQL = "floor(({0}.latitude + 90) / 30) = floor(({1}.latitude + 90) / 30) AND floor(({0}.longitude - 360 * floor({0}.longitude / 360)) / 60) = floor(({1}.longitude - 360 * floor({1}.longitude / 360)) / 60)".format("a", "b")


@query("AR14", f"""WITH {PRED}, {_REACH.removeprefix("WITH ")}, w AS (SELECT profile_no, station_no, time, latitude, longitude, {_WIDE} FROM pred WHERE {LEVEL} IN {_TENSOR} GROUP BY ALL HAVING count(*) = {len(_TENSOR)}),
z AS (SELECT {_SCALE} FROM w WHERE time < TIMESTAMP '{DEV}'), f AS (SELECT w.*, z.*, {" + ".join(f"{i + 1} * ({x})" for i, x in enumerate(_OWN_SQL))} AS own FROM w, z),
nb AS (SELECT a.profile_no, b.profile_no AS neighbour, km, x - 360 * floor(x / 360) AS bearing, row_number() OVER (PARTITION BY a.profile_no ORDER BY round(km, 6), b.profile_no) AS rank FROM f a JOIN reach USING (station_no) JOIN f b ON b.station_no = other AND b.time = a.time WHERE km <= 5000),
k AS (SELECT nb.*, b.own + {" + ".join(f"{len(_OWN_SQL) + i + 1} * ({x})" for i, x in enumerate(_PAIR_SQL))} AS v, row_number() OVER (PARTITION BY nb.profile_no ORDER BY rank) AS slot FROM nb JOIN f a ON a.profile_no = nb.profile_no JOIN f b ON b.profile_no = nb.neighbour WHERE rank <= {_LOOKED}
  AND CASE nb.profile_no % 3 WHEN 0 THEN CAST('0x' || substr(md5('14:' || nb.profile_no || ':' || neighbour), 1, 8) AS BIGINT) % 10 < 5 WHEN 1 THEN NOT ({_BLOCK_SQL}) ELSE km >= 500 END),
c AS (SELECT profile_no, count(*) AS n, min(km) AS nearest_km, sum(slot * v) AS checksum FROM k WHERE slot <= {_SLOTS} GROUP BY 1) SELECT profile_no, coalesce(n, 0) AS n, round(coalesce(nearest_km, 1e6), 6) AS nearest_km, round(coalesce(checksum, 0), 4) AS checksum FROM f LEFT JOIN c USING (profile_no)""")
def context_tensor(spark, path):
    """Checksums that read every entry of context(): the weight of an entry is its place, that of a slot its number."""
    slot = lambda s: F.aggregate(F.concat(s["own"], s["pair"]), F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("i")), lambda a, x: F.struct((a["v"] + (a["i"] + 1) * x).alias("v"), (a["i"] + 1).alias("i")), lambda a: a["v"])
    checksum = F.aggregate("slots", F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("i")), lambda a, s: F.struct((a["v"] + F.when(s["mask"], (a["i"] + 1) * slot(s)).otherwise(0.0)).alias("v"), (a["i"] + 1).alias("i")), lambda a: a["v"])
    return context(spark, path).select("profile_no", "n", r6("nearest_km", "nearest_km"), F.round(checksum, 4).alias("checksum"))


def context(spark, path, within_km: float = 5000.0) -> DataFrame:
    """profile_no, slots (_SLOTS structs: mask, 19 own and 6 relative features; zeros where the mask is false), n, nearest_km (1e6 if there is none).

    Own: standardised background refractivity and height, correction, place and calendar, standardised innovation, three
    levels each. Relative: log distance, bearing, standardised differences to the target's refractivity. Of the nearest
    profiles of other stations at the same time a policy by profile drops some: by chance, those of its own block, or
    those nearer than 500 km. Profiles that lack one of the levels have no tensor and are no context.
    """
    rows = predicted(spark, path).where(F.col(LEVEL).isin(*_TENSOR))
    values = {"n": F.col("bg_total"), "h": F.col("height_m") / 1000.0, "r": F.col("residual_total"), "c": F.col("correction"), "i": F.col("residual_total") - F.col("correction")}
    wide = rows.groupBy("profile_no", "station_no", "time", "latitude", "longitude").agg(F.count("*").alias("k"), *(F.max(F.when(F.col(LEVEL) == p, v)).alias(f"{k}_{p}") for p in _TENSOR for k, v in values.items())).where(f"k = {len(_TENSOR)}")
    scale = wide.where(F.col("time") < _at(DEV)).agg(*(f(f"{k}_{p}").alias(f"{a}{k}_{p}") for p in _TENSOR for k in "nhr" for f, a in ((F.avg, "m"), (F.stddev_pop, "s"))))
    wide = text.staged(wide.join(F.broadcast(scale)), "wide")  # one row
    scaled = lambda k, of: [(F.col(f"{k}_{p}") - F.col(f"m{of}_{p}")) / F.col(f"s{of}_{p}") for p in _TENSOR]
    place = list((feature_sets.coordinates(F.col("latitude"), F.col("longitude")) | feature_sets.calendar(F.col("time"))).values())
    own = F.array(*scaled("n", "n"), *scaled("h", "h"), *scaled("c", "r"), *place, *scaled("i", "r"))
    near = spatial.nearest(wide, wide, "profile_no", _LOOKED, ("time",), "station_no", within_km)
    chance = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("14"), F.col("target").cast("string"), F.col("neighbour").cast("string"))), 1, 8), 16, 10).cast("long") % 10 < 5
    far = geo.block(F.col("latitude"), F.col("longitude")) != geo.block(F.col("lat_b"), F.col("lon_b"))
    policy = F.col("target") % 3
    kept = near.where(F.when(policy == 0, chance).when(policy == 1, far).otherwise(F.col("km") >= 500))
    kept = kept.withColumn("slot", F.row_number().over(Window.partitionBy("target").orderBy("rank"))).where(F.col("slot") <= _SLOTS).select("target", "neighbour", "slot", "km", "bearing")
    theirs = wide.select(F.col("profile_no").alias("neighbour"), own.alias("own"), *(F.col(f"n_{p}").alias(f"b_{p}") for p in _TENSOR))
    mine = wide.select(F.col("profile_no").alias("target"), *(F.col(f"{k}_{p}") for p in _TENSOR for k in ("n", "sn")))
    o = F.radians("bearing")
    pair = F.array(F.log(1 + F.col("km") / 100), F.sin(o), F.cos(o), *((F.col(f"b_{p}") - F.col(f"n_{p}")) / F.col(f"sn_{p}") for p in _TENSOR))
    full = kept.join(theirs, "neighbour").join(mine, "target").select("target", F.struct(F.col("slot"), F.col("km"), F.lit(True).alias("mask"), F.col("own"), pair.alias("pair")).alias("s"))
    tensors = full.groupBy("target").agg(F.array_sort(F.collect_list("s")).alias("found"))  # _SLOTS a profile
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    empty = F.struct(F.lit(0).alias("slot"), F.lit(1e6).alias("km"), F.lit(False).alias("mask"), zeros(19).alias("own"), zeros(6).alias("pair"))
    both = wide.select("profile_no").join(tensors, F.col("profile_no") == F.col("target"), "left").withColumn("n", F.when(F.col("found").isNull(), 0).otherwise(F.size("found")).cast("long"))
    slots = F.slice(F.concat(F.coalesce("found", F.array().cast("array<struct<slot:int,km:double,mask:boolean,own:array<double>,pair:array<double>>>")), F.array_repeat(empty, _SLOTS)), 1, _SLOTS)
    return both.select("profile_no", slots.alias("slots"), "n").withColumn("nearest_km", F.array_min(F.transform("slots", lambda s: s["km"])))


@query("JN15", f"""WITH {fields._PAIRS}, {OBS}, c AS (SELECT station_no AS neighbour, month(time) AS m, hour(time) AS h, {LEVEL}, avg(residual_total) AS r FROM obs WHERE valid AND time < TIMESTAMP '{DEV}' GROUP BY ALL),
k AS (SELECT target, m, h, {LEVEL}, avg(r) AS p FROM near JOIN c USING (neighbour) WHERE rank <= 8 GROUP BY ALL), g AS (SELECT avg(residual_total) AS g FROM obs WHERE valid AND time < TIMESTAMP '{DEV}')
SELECT o.{LEVEL}, count(*) AS n, count(p) AS n_local, round(sqrt(avg(pow(coalesce(p, g) - residual_total, 2))), 6) AS rmse FROM obs o CROSS JOIN g LEFT JOIN k ON k.target = o.station_no AND k.m = month(time) AND k.h = hour(time) AND k.{LEVEL} = o.{LEVEL} WHERE valid AND time >= TIMESTAMP '{DEV}' GROUP BY 1""")
def neighbour_climatology(spark, path):
    """Cells are stations x months x two hours x levels, 17,280 at most, so they are broadcast; the global mean is one row."""
    rows = observed(spark, path).where("valid").withColumn("m", F.month("time")).withColumn("h", F.hour("time"))
    old, new = rows.where(F.col("time") < _at(DEV)), rows.where(F.col("time") >= _at(DEV))
    s = src.stations(spark, path)
    near = spatial.neighbours(s, s, "station_no", 8).select("target", "neighbour")
    cells = old.groupBy(F.col("station_no").alias("neighbour"), "m", "h", LEVEL).agg(F.avg("residual_total").alias("r"))
    local = near.join(cells, "neighbour").groupBy(F.col("target").alias("station_no"), "m", "h", LEVEL).agg(F.avg("r").alias("p"))
    both = new.join(F.broadcast(local), ["station_no", "m", "h", LEVEL], "left").crossJoin(F.broadcast(old.agg(F.avg("residual_total").alias("g"))))
    e = F.coalesce("p", "g") - F.col("residual_total")
    return both.groupBy(LEVEL).agg(F.count("*").alias("n"), F.count("p").alias("n_local"), r6(F.sqrt(F.avg(e * e)), "rmse"))


_WRAP = lambda x: f"({x} + 180 - 360 * floor(({x} + 180) / 360) - 180)"


@query("JN10", f"""WITH {OBS}, r AS (SELECT profile_no, {LEVEL} AS p, CAST(line_no * 300 + l_quantity AS DOUBLE) AS s, latitude + line_no * {d(0.05)} AS la, {_WRAP(f"longitude + line_no * {d(0.7)}")} AS lo FROM obs),
n AS (SELECT *, lead(p) OVER w AS p1, lead(s) OVER w AS s1, lead(la) OVER w AS la1, lead(lo) OVER w AS lo1 FROM r WINDOW w AS (PARTITION BY profile_no ORDER BY p DESC)),
f AS (SELECT *, (ln(p) - ln(target)) / (ln(p) - ln(p1)) AS f FROM n JOIN (SELECT unnest([950, 800, 600, 400]) AS target) ON target <= p AND target > p1)
SELECT profile_no, target, round(s + f * (s1 - s), 6) AS seconds, round(la + f * (la1 - la), 6) AS latitude, round({_WRAP(f"lo + f * {_WRAP('lo1 - lo')}")}, 6) AS longitude FROM f""")
def measured_time(spark, path):
    """Time and place of a target pressure between two reported levels, linear in log pressure, longitude by the shorter way; each pair of levels lists the targets it holds."""
    n = F.col("line_no")
    quantity = F.col("height_m") - src.lookup(n, src.HEIGHTS)
    r = observed(spark, path).select(
        "profile_no", F.col(LEVEL).alias("p"), (n * 300 + quantity).cast("double").alias("s"), (F.col("latitude") + n * 0.05).alias("la"), geo.wrapped(F.col("longitude") + n * 0.7).alias("lo")
    )
    by = Window.partitionBy("profile_no").orderBy(F.desc("p"))
    r = r.select("*", *(F.lead(c).over(by).alias(f"{c}1") for c in ("p", "s", "la", "lo"))).where("p1 IS NOT NULL")
    r = r.withColumn("target", F.explode(F.filter(F.array(*(F.lit(x) for x in (950, 800, 600, 400))), lambda x: (x <= F.col("p")) & (x > F.col("p1")))))
    r = r.withColumn("f", (F.log("p") - F.log("target")) / (F.log("p") - F.log("p1")))
    between = lambda c: F.col(c) + F.col("f") * (F.col(f"{c}1") - F.col(c))
    return r.select("profile_no", "target", r6(between("s"), "seconds"), r6(between("la"), "latitude"), r6(geo.wrapped(F.col("lo") + F.col("f") * geo.wrapped(F.col("lo1") - F.col("lo"))), "longitude"))


@query("AG44", f"""WITH {PRED}, w AS (SELECT profile_no, sd, obs_total AS y, bg_total + correction AS p, height_m AS h, lag(height_m) OVER w AS h0, lead(height_m) OVER w AS h2, lag(obs_total) OVER w AS y0, lead(obs_total) OVER w AS y2 FROM pred WINDOW w AS (PARTITION BY profile_no ORDER BY height_m, {LEVEL} DESC)),
e AS (SELECT *, y0 + (y2 - y0) * (h - h0) / (h2 - h0) AS yi FROM w WHERE h2 > h0),
s AS (SELECT profile_no, count(*) AS n, sum(pow(p - y, 2)) AS native, sum(pow(p - yi, 2)) AS interpolated, sum(pow(yi - y, 2)) AS eta, sum((p - yi) * (yi - y)) AS cross_term, count(*) FILTER (abs(p - yi) <= {d(1.645)} * sd) AS inside, sum(sd) AS sd FROM e GROUP BY 1)
SELECT count(*) AS profiles, CAST(sum(n) AS BIGINT) AS n, round(sqrt(sum(native) / sum(n)), 6) AS rmse_native, round(sqrt(sum(interpolated) / sum(n)), 6) AS rmse_interpolated, round(sqrt(sum(eta) / sum(n)), 6) AS rmse_eta, round(sum(cross_term) / sum(n), 4) AS cross_term, round(sum(inside) / sum(n), 6) AS coverage, round(2 * {d(1.645)} * sum(sd) / sum(n), 6) AS width FROM s""")
def representation_error(spark, path):
    """Error against a level's own value = error against the value interpolated from its neighbours + what interpolation adds; sums by profile, then over all."""
    by = Window.partitionBy("profile_no").orderBy("height_m", F.desc(LEVEL))
    h, y, p = F.col("height_m"), F.col("obs_total"), F.col("bg_total") + F.col("correction")
    rows = predicted(spark, path).select("profile_no", "sd", y.alias("y"), p.alias("p"), h.alias("h"), F.lag(h).over(by).alias("h0"), F.lead(h).over(by).alias("h2"), F.lag(y).over(by).alias("y0"), F.lead(y).over(by).alias("y2")).where("h2 > h0")
    rows = rows.withColumn("yi", F.col("y0") + (F.col("y2") - F.col("y0")) * (F.col("h") - F.col("h0")) / (F.col("h2") - F.col("h0")))
    native, own, eta = F.col("p") - F.col("y"), F.col("p") - F.col("yi"), F.col("yi") - F.col("y")
    s = rows.groupBy("profile_no").agg(
        F.count("*").alias("n"), F.sum(native * native).alias("native"), F.sum(own * own).alias("interpolated"), F.sum(eta * eta).alias("eta"), F.sum(own * eta).alias("cross_term"), F.count_if(F.abs(own) <= 1.645 * F.col("sd")).alias("inside"), F.sum("sd").alias("sd")
    )
    part = lambda c: F.sum(c) / F.sum("n")
    return s.agg(
        F.count("*").alias("profiles"), F.sum("n").alias("n"), r6(F.sqrt(part("native")), "rmse_native"), r6(F.sqrt(part("interpolated")), "rmse_interpolated"), r6(F.sqrt(part("eta")), "rmse_eta"), F.round(part("cross_term"), 4).alias("cross_term"),
        r6(part("inside"), "coverage"), r6(2 * 1.645 * part("sd"), "width"),
    )


@query("SL4", f"""WITH {src.STATIONS_SQL}, b AS (SELECT 'b' || CAST(floor((latitude + 90) / 30) AS BIGINT) || '_' || CAST(floor((longitude + 180) / 60) AS BIGINT) AS name, latitude < 0 AS south FROM stations), c AS (SELECT name, bool_or(south) AS south, count(*) AS n FROM b GROUP BY 1 HAVING count(*) >= 2),
r AS (SELECT name, n, south AND row_number() OVER (PARTITION BY south ORDER BY n DESC, name) <= 2 AS reserved FROM c) SELECT name, n, reserved, row_number() OVER (ORDER BY reserved DESC, n DESC, name) AS rank FROM r QUALIFY rank <= 6""")
def blocks(spark, path):
    """Six blocks of at least two stations, two places reserved for southern ones, then by count and name. Blocks are 36 at most when they are ranked."""
    name = F.concat(F.lit("b"), F.floor((F.col("latitude") + 90) / 30), F.lit("_"), F.floor((F.col("longitude") + 180) / 60))
    c = src.stations(spark, path).groupBy(name.alias("name")).agg(F.bool_or(F.col("latitude") < 0).alias("south"), F.count("*").alias("n")).where("n >= 2")
    first = F.row_number().over(Window.partitionBy("south").orderBy(F.desc("n"), "name"))
    r = c.select("name", "n", (F.col("south") & (first <= 2)).alias("reserved"))
    rank = F.row_number().over(Window.orderBy(F.desc("reserved"), F.desc("n"), "name"))
    return r.withColumn("rank", rank.cast("long")).where("rank <= 6")


# Models

FEATURES = ("bg_temperature_k", "bg_q", "pressure_hpa", "latitude", "elevation_m", "month")


def boosted(spark, path):
    """Boosted trees for the dry and the wet part, fitted before DEV; no SQL twin. Errors by level on later rows, beside those without a correction.

    Rows are written once: each fit reads its input several times before it keeps it, and would join lines and orders each time.
    """
    rows = predicted(spark, path).withColumn("month", F.month("time"))
    rows = text.staged(rows.select("time", *FEATURES, "residual_dry", "residual_wet", "residual_total"), "features")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    old, new = rows.where(F.col("time") < _at(DEV)), rows.where(F.col("time") >= _at(DEV))
    for part in ("dry", "wet"):
        model = GBTRegressor(labelCol=f"residual_{part}", maxDepth=3, maxIter=10, stepSize=0.1, minInstancesPerNode=20, seed=7, predictionCol=f"boosted_{part}").fit(old.select("features", f"residual_{part}"))
        new = model.transform(new)
    e, raw = F.col("boosted_dry") + F.col("boosted_wet") - F.col("residual_total"), F.col("residual_total")
    return new.groupBy(LEVEL).agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(e * e)), "rmse"), r6(F.sqrt(F.avg(raw * raw)), "rmse_raw"))


Q["ML3"] = boosted

_FIELD = ", ".join(f"({p}, {h})" for p, h in zip(src.LEVELS, src.HEIGHTS))


@query("ML12", f"""WITH {PRED}, {src.TARGETS_SQL}, {src.GRID_SQL}, l AS (SELECT {LEVEL}, avg(residual_total) AS c FROM pred WHERE time < TIMESTAMP '{DEV}' GROUP BY 1), h({LEVEL}, height) AS (VALUES {_FIELD}),
f AS (SELECT t, a, o, {LEVEL}, height, CASE WHEN 850 + 20 * v >= {LEVEL} THEN 300 * exp(-height / {d(7000.0)}) + v + c + {d(0.157)} * height END AS m FROM grid, h JOIN l USING ({LEVEL}) WHERE t IN (SELECT CAST(floor(tpos) AS BIGINT) FROM targets)),
g AS (SELECT *, 1000 * (lead(m) OVER w - m) / (lead(height) OVER w - height) AS k FROM f WINDOW w AS (PARTITION BY t, a, o ORDER BY {LEVEL} DESC))
SELECT {LEVEL}, count(m) AS n, round(avg(m), 6) AS m_corrected, round(avg(k), 6) AS gradient_per_km FROM g GROUP BY 1""")
def corrected_field(spark, path):
    """The learnt correction on a field's cells: nothing below the ground, modified refractivity and its gradient to the level above. Corrections are six rows."""
    times = src.targets(spark, path).select(F.floor("tpos").alias("t")).distinct()
    c = predicted(spark, path).where(F.col("time") < _at(DEV)).groupBy(LEVEL).agg(F.avg("residual_total").alias("c"))
    levels = F.array(*(F.struct(F.lit(p).alias(LEVEL), F.lit(h).alias("height")) for p, h in zip(src.LEVELS, src.HEIGHTS)))
    f = src.grid(spark).join(F.broadcast(times), "t", "left_semi").select("t", "a", "o", "v", F.inline(levels)).join(F.broadcast(c), LEVEL)
    n = 300 * F.exp(-F.col("height") / 7000.0) + F.col("v") + F.col("c")
    f = f.withColumn("m", F.when(850 + 20 * F.col("v") >= F.col(LEVEL), n + 0.157 * F.col("height")))
    by = Window.partitionBy("t", "a", "o").orderBy(F.desc(LEVEL))
    f = f.withColumn("k", 1000 * (F.lead("m").over(by) - F.col("m")) / (F.lead("height").over(by) - F.col("height")))
    return f.groupBy(LEVEL).agg(F.count("m").alias("n"), r6(F.avg("m"), "m_corrected"), r6(F.avg("k"), "gradient_per_km"))


_WEIGHT = "least(1, greatest(0, sum((y - b) * (a - b)) / greatest(sum((a - b) * (a - b)), 1e-12)))"


@query("ML11", f"""WITH {src.SERIES_SQL}, c AS (SELECT layer, value AS a, avg(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS b, lead(value, 1) OVER w AS y, (row_number() OVER w - 1) / count(*) OVER (PARTITION BY station) AS part FROM series WINDOW w AS (PARTITION BY station ORDER BY ts, event_id)),
w AS (SELECT layer, {_WEIGHT} AS w FROM c WHERE y IS NOT NULL AND part >= {d(0.7)} AND part < {d(0.85)} GROUP BY 1)
SELECT layer, count(*) AS n_test, round(any_value(w), 6) AS weight, round(sqrt(avg(pow(w * a + (1 - w) * b - y, 2))), 6) AS rmse FROM c JOIN w USING (layer) WHERE y IS NOT NULL AND part >= {d(0.85)} GROUP BY 1""")
def adaptive_ensemble(spark, path):
    """Weights of the candidates come from the validation part of each station's reports, errors from its test part."""
    by = Window.partitionBy("station").orderBy("ts", "event_id")
    at = (F.row_number().over(by) - 1) / F.count("*").over(Window.partitionBy("station"))
    rows = src.series(spark, path).select("layer", F.col("value").alias("a"), F.avg("value").over(by.rowsBetween(-4, 0)).alias("b"), F.lead("value").over(by).alias("y"), at.alias("at")).where("y IS NOT NULL")
    weights = rows.where("at >= 0.7D AND at < 0.85D").groupBy("layer").agg(ensemble_weight().alias("w"))  # a row a layer
    e = F.col("w") * F.col("a") + (1 - F.col("w")) * F.col("b") - F.col("y")
    return rows.where("at >= 0.85D").join(F.broadcast(weights), "layer").groupBy("layer").agg(F.count("*").alias("n_test"), r6(F.first("w"), "weight"), r6(F.sqrt(F.avg(e * e)), "rmse"))


# Streams: the same jobs as on streams, run on a batch


@query("ST3", f"WITH {src.LEVELS_SQL}, k AS (SELECT DISTINCT station_no, time, {LEVEL} FROM lv), a AS (SELECT station_no, count(*) AS n_reports FROM lv GROUP BY 1) SELECT station_no, count(*) AS n_kept, any_value(n_reports) - count(*) AS n_rejected FROM k JOIN a USING (station_no) GROUP BY 1")
def without_duplicates(spark, path):
    rows = src.levels(spark, path).select("station_no", "time", LEVEL)
    kept = streams.once(rows, ["station_no", "time", LEVEL], "time").groupBy("station_no").agg(F.count("*").alias("n_kept"))
    return rows.groupBy("station_no").agg(F.count("*").alias("n")).join(kept, "station_no").select("station_no", "n_kept", (F.col("n") - F.col("n_kept")).alias("n_rejected"))


@query("ST4", f"WITH {src.SERIES_SQL} SELECT date_trunc('day', ts)::TIMESTAMP AS day, layer AS reason, count(*) AS n FROM series GROUP BY ALL")
def day_counters(spark, path):
    rows = streams.counters(src.series(spark, path), "ts", "layer")
    return rows.select(F.col("day").cast("timestamp_ntz").alias("day"), F.col("layer").alias("reason"), "n")


@query("ST5", f"WITH {src.SERIES_SQL}, w AS (SELECT station, value, unnest([date_trunc('day', ts) + to_days(CAST(k AS INT)) FOR k IN range(1, 8)]) AS until FROM series) SELECT station, until::TIMESTAMP AS until, count(*) AS n, round(avg(value), 6) AS value FROM w GROUP BY ALL")
def rolling_means(spark, path):
    return streams.rolling(src.series(spark, path)).select("station", F.col("until").cast("timestamp_ntz").alias("until"), "n", r6("value", "value"))


@query("ST5_last_rows", f"""WITH {src.SERIES_SQL}, f AS (SELECT station, event_id, value, avg(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m, CASE WHEN lag(value, 5) OVER w IS NOT NULL THEN value + 2 * greatest(-1, least(1, (value - lag(value, 5) OVER w) / 5)) END AS t FROM series WINDOW w AS (PARTITION BY station ORDER BY ts, event_id))
SELECT station, event_id, round(value, 6) AS value, round(m, 6) AS recent_mean, round(t, 6) AS trend FROM f""")
def last_rows(spark, path):
    """The batch form; on a stream the same function keeps state and timers, and its test compares both."""
    rows = state.last_rows(src.series(spark, path), 5, 2)
    return rows.select("station", "event_id", *(r6(c, c) for c in ("value", "recent_mean", "trend")))


@query("ST1", fields.SQL["JN4"])
def collocated(spark, path):
    """Reports are collocated with the field as their files come; a run takes the new ones."""
    events = spark.read.parquet(f"{path}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{path}/events*.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    out, state = text.scratch(spark, "collocated"), text.scratch(spark, "collocated-state")

    def job(batch: DataFrame) -> DataFrame:
        points = src.places(batch).select("id", F.floor("tpos").alias("t"), "lat", "lon")
        return spatial.bilinear(points, src.grid(batch.sparkSession)).select("id", r6("value", "value"))

    streams.incremental(stream, job, out, state)
    return spark.read.parquet(out).select("id", "value")
