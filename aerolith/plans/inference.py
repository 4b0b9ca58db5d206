"""Bootstraps, quotas, models and interpolation weights, each with its SQL. Draws are hashes, so any engine can repeat them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import geo
from aerolith.operators import spatial
from aerolith.plans.formulas import LEVEL
from aerolith.plans.registry import d, r6, registry
from aerolith.plans.soundings import CAL, DEV, OBS, PRED, observed, predicted
from aerolith.sources import levels as src

Q, SQL, query = registry()
#: Replicates of the queries.
REPLICATES = 10_000


def draws(units: DataFrame, unit: str, seed: int, replicates: int = REPLICATES, within: tuple[str, ...] = ()) -> DataFrame:
    """units (one row each) with replicate and times: how often it is drawn there.

    Each unit counts its draws by itself, as many as a Poisson variable of mean one from its own hash, so no draw has to
    find its unit: no join, no numbering of units, no place that has to know them all.
    """
    # Units are few rows in few tasks by now: stretches of replicates are dealt out first, each then counts its own.
    parts = max(1, min(64, replicates // 100))
    ends = [replicates * k // parts for k in range(parts + 1)]
    stretches = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b - 1).alias("b")) for a, b in zip(ends, ends[1:], strict=False))))
    dealt = units.withColumn("__part", stretches).repartition(parts, "__part")
    each = dealt.withColumn("replicate", F.explode(F.sequence("__part.a", "__part.b"))).drop("__part")
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "replicate", *(F.col(c).cast("string") for c in (*within, unit)))), 1, 8), 16, 10).cast("double") / 4294967296.0
    times = sum((F.when(F.col("__u") >= c, 1).otherwise(0) for c in POISSON), F.lit(0))
    # Generated, not projected: what follows doesn't compute the hash again for each of its bounds.
    return each.withColumn("__u", F.explode(F.array(u))).withColumn("times", times).where("times > 0").drop("__u")


#: The Poisson distribution of mean one, below 1, 2, 3 and so on.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def draws_sql(units: str, keys: str, seed: int, replicates: int = REPLICATES) -> str:
    u = f"CAST('0x' || substr(md5('{seed}:' || replicate || ':' || {keys}), 1, 8) AS BIGINT) / {d(4294967296.0)}"
    return f"(SELECT * FROM (SELECT *, {' + '.join(f'CASE WHEN u >= {d(c)} THEN 1 ELSE 0 END' for c in POISSON)} AS times FROM (SELECT *, {u} AS u FROM {units}, range({replicates}) r(replicate))) WHERE times > 0)"


def limits(rows: DataFrame, value: Column, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(r6(F.percentile(value, F.lit(0.025)), "low"), r6(F.avg(value), "mean"), r6(F.percentile(value, F.lit(0.975)), "high"), F.count(value).alias("replicates"))


_LIMITS = "round(quantile_cont(x, 0.025), 6) AS low, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.975), 6) AS high, count(x) AS replicates"
_SUMS = "count(*) AS n, sum(error * error) AS m, sum(residual_total * residual_total) AS g, sum(abs(error)) AS a, sum(error) AS s"


def sums(rows: DataFrame, *by: str) -> DataFrame:
    e, g = F.col("error"), F.col("residual_total")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(e * e).alias("m"), F.sum(g * g).alias("g"), F.sum(F.abs(e)).alias("a"), F.sum(e).alias("s"))


def total(name: str) -> Column:
    return F.sum(F.col("times") * F.col(name))


def delta() -> Column:
    return F.sqrt(total("m") / total("n")) - F.sqrt(total("g") / total("n"))


_DELTA = "sqrt(sum(times * m) / sum(times * n)) - sqrt(sum(times * g) / sum(times * n))"
_UNITS = f"{PRED}, u AS (SELECT station_no, {_SUMS} FROM pred GROUP BY 1)"


@query("RS6", f"""WITH {PRED}, u AS (SELECT station_no, avg(error) AS v FROM pred GROUP BY 1), b AS (SELECT replicate, sum(times * v) / sum(times) AS x FROM {draws_sql('u', 'station_no', 5)} GROUP BY 1) SELECT {_LIMITS} FROM b""")
def mean_bootstrap(spark, path):
    u = predicted(spark, path).groupBy("station_no").agg(F.avg("error").alias("v"))
    b = draws(u, "station_no", 5).groupBy("replicate").agg((total("v") / F.sum("times")).alias("x"))
    return limits(b, F.col("x"))


@query("RS7", f"WITH {_UNITS}, b AS (SELECT replicate, {_DELTA} AS x FROM {draws_sql('u', 'station_no', 17)} GROUP BY 1) SELECT {_LIMITS} FROM b")
def ratio_bootstrap(spark, path):
    """Sums of stations are drawn and pooled, then divided."""
    return limits(draws(sums(predicted(spark, path), "station_no"), "station_no", 17).groupBy("replicate").agg(delta().alias("x")), F.col("x"))


@query("RS8", f"""WITH {_UNITS}, b AS (SELECT replicate, {_DELTA} AS rmse, sum(times * a) / sum(times * n) AS mae, sum(times * s) / sum(times * n) AS bias, sum(times * sqrt(m / n)) / sum(times) AS station_rmse FROM {draws_sql('u', 'station_no', 8)} GROUP BY 1),
l AS (UNPIVOT (SELECT rmse, mae, bias, station_rmse FROM b) ON rmse, mae, bias, station_rmse INTO NAME metric VALUE x) SELECT metric, {_LIMITS} FROM l GROUP BY 1""")
def paired_bootstrap(spark, path):
    """All metrics of a replicate come from the same draws of stations."""
    b = draws(sums(predicted(spark, path), "station_no"), "station_no", 8).groupBy("replicate").agg(
        delta().alias("rmse"), (total("a") / total("n")).alias("mae"), (total("s") / total("n")).alias("bias"), (F.sum(F.col("times") * F.sqrt(F.col("m") / F.col("n"))) / F.sum("times")).alias("station_rmse")
    )
    return limits(b.unpivot(["replicate"], ["rmse", "mae", "bias", "station_rmse"], "metric", "x"), F.col("x"), "metric")


@query("RS9", f"""WITH {PRED}, u AS (SELECT station_no, month(time) AS m_no, {_SUMS} FROM pred GROUP BY ALL), s AS (SELECT replicate, station_no, times AS outer_times FROM {draws_sql('(SELECT DISTINCT station_no FROM u)', 'station_no', 9)}),
c AS (SELECT replicate, station_no, m_no, times AS inner_times, n, m, g FROM {draws_sql('u', "station_no || ':' || m_no", 90)}), t AS (SELECT replicate, inner_times * outer_times AS times, n, m, g FROM c JOIN s USING (replicate, station_no)),
b AS (SELECT replicate, {_DELTA} AS x FROM t GROUP BY 1) SELECT {_LIMITS} FROM b""")
def hierarchical_bootstrap(spark, path):
    """Stations, then months within each drawn station: the times of both multiply."""
    cells = sums(predicted(spark, path).withColumn("m_no", F.month("time")), "station_no", "m_no")
    inner = draws(cells, "m_no", 90, within=("station_no",)).withColumnRenamed("times", "inner")
    both = draws(inner.select("station_no").distinct(), "station_no", 9).withColumnRenamed("times", "outer")
    rows = inner.join(both, ["replicate", "station_no"]).withColumn("times", F.col("inner") * F.col("outer"))
    return limits(rows.groupBy("replicate").agg(delta().alias("x")), F.col("x"))


@query("RS10", f"""WITH {PRED}, k AS (SELECT unnest(['station', 'month', 'day', 'archive']) AS kind, unnest([CAST(station_no AS VARCHAR), strftime(time, '%Y-%m'), strftime(time, '%m-%d'), pressure_flag || temperature_flag]) AS unit, error, residual_total FROM pred),
u AS (SELECT kind, unit, {_SUMS} FROM k GROUP BY ALL), b AS (SELECT kind, replicate, {_DELTA} AS x FROM {draws_sql('u', "kind || ':' || unit", 10)} GROUP BY ALL) SELECT kind, {_LIMITS} FROM b GROUP BY 1""")
def units_bootstrap(spark, path):
    """One operator, four units: every row goes to its unit of each kind once, sums are resampled."""
    units = {"station": F.col("station_no").cast("string"), "month": F.date_format("time", "yyyy-MM"), "day": F.date_format("time", "MM-dd"), "archive": F.concat("pressure_flag", "temperature_flag")}
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), u.alias("unit")) for k, u in units.items())))
    rows = predicted(spark, path).select(kinds.alias("k"), "error", "residual_total").select("k.*", "error", "residual_total")
    return limits(draws(sums(rows, "kind", "unit"), "unit", 10, within=("kind",)).groupBy("kind", "replicate").agg(delta().alias("x")), F.col("x"), "kind")


@query("RS11", f"""WITH {PRED}, k AS (SELECT unnest(['level', 'flag']) AS grouping_, unnest([CAST({LEVEL} AS VARCHAR), pressure_flag]) AS grp, station_no, error, residual_total FROM pred), u AS (SELECT grouping_, grp, station_no, {_SUMS} FROM k GROUP BY ALL),
b AS (SELECT grouping_, grp, replicate, {_DELTA} AS x FROM {draws_sql('u', "station_no", 11)} GROUP BY ALL) SELECT grouping_ AS grouping, grp AS "group", {_LIMITS} FROM b GROUP BY grouping_, grp""")
def grouped_bootstrap(spark, path):
    groups = F.explode(F.array(F.struct(F.lit("level").alias("grouping"), F.col(LEVEL).cast("string").alias("group")), F.struct(F.lit("flag").alias("grouping"), F.col("pressure_flag").alias("group"))))
    rows = predicted(spark, path).select(groups.alias("k"), "station_no", "error", "residual_total").select("k.*", "station_no", "error", "residual_total")
    b = draws(sums(rows, "grouping", "group", "station_no"), "station_no", 11).groupBy("grouping", "group", "replicate").agg(delta().alias("x"))
    return limits(b, F.col("x"), "grouping", "group")


@query("RS12", f"""WITH {PRED}, u AS (SELECT CAST(time AS DATE) AS day, count(*) AS n, sum(CASE WHEN abs(error) <= sd * {d(1.64485362695147)} THEN 1 ELSE 0 END) AS inside, sum(pow(error / sd, 2) / 2 + ln(sd)) AS nll FROM pred GROUP BY 1),
b AS (SELECT replicate, sum(times * inside) / sum(times * n) AS coverage, sum(times * nll) / sum(times * n) AS nll FROM {draws_sql('u', "day", 12)} GROUP BY 1), l AS (UNPIVOT (SELECT CAST(coverage AS DOUBLE) AS coverage, nll FROM b) ON coverage, nll INTO NAME metric VALUE x) SELECT metric, {_LIMITS} FROM l GROUP BY 1""")
def score_bootstrap(spark, path):
    e, s = F.col("error"), F.col("sd")
    u = predicted(spark, path).groupBy(F.to_date("time").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.abs(e) <= s * 1.64485362695147).alias("inside"), F.sum(F.pow(e / s, F.lit(2)) / 2 + F.log(s)).alias("nll"))
    b = draws(u, "day", 12).groupBy("replicate").agg((total("inside") / total("n")).alias("coverage"), (total("nll") / total("n")).alias("nll"))
    return limits(b.unpivot(["replicate"], ["coverage", "nll"], "metric", "x"), F.col("x"), "metric")


@query("RS13", f"""WITH {PRED}, r AS (SELECT station_no, sqrt(avg(pow(error, 2))) - sqrt(avg(pow(residual_total, 2))) AS s1, sqrt(avg(pow(correction / 2 - residual_total, 2))) - sqrt(avg(pow(residual_total, 2))) AS s2 FROM pred GROUP BY 1), u AS (SELECT station_no, (s1 + s2) / 2 AS v FROM r),
b AS (SELECT replicate, sum(times * v) / sum(times) AS x FROM {draws_sql('u', 'station_no', 13)} GROUP BY 1) SELECT {_LIMITS} FROM b""")
def station_contrast(spark, path):
    """Two runs as columns, averaged by station before stations are drawn."""
    r = F.col("residual_total")
    rms = lambda c: F.sqrt(F.avg(c * c))
    u = predicted(spark, path).groupBy("station_no").agg((((rms(F.col("error")) - rms(r)) + (rms(F.col("correction") / 2 - r) - rms(r))) / 2).alias("v"))
    b = draws(u, "station_no", 13).groupBy("replicate").agg((total("v") / F.sum("times")).alias("x"))
    return limits(b, F.col("x"))


@query("RS1", f"""WITH {src.STATIONS_SQL}, c AS (SELECT CASE WHEN latitude >= 30 THEN 'north' WHEN latitude <= -30 THEN 'south' ELSE 'tropics' END AS region, count(*) AS n FROM stations GROUP BY 1), f AS (SELECT region, n, unnest(['train', 'calibration', 'test']) AS role, unnest([{d(0.7)}, {d(0.1)}, {d(0.2)}]) AS share FROM c),
q AS (SELECT *, floor(n * share) AS base, n - sum(floor(n * share)) OVER (PARTITION BY region) AS spare, row_number() OVER (PARTITION BY region ORDER BY round(n * share - floor(n * share), 9) DESC, role) AS k FROM f),
m AS (SELECT region, role, n, base + CASE WHEN k <= spare THEN 1 ELSE 0 END AS quota FROM q), z AS (SELECT *, count(*) FILTER (quota = 0) OVER (PARTITION BY region) AS missing, row_number() OVER (PARTITION BY region ORDER BY quota DESC, role) AS rich FROM m)
SELECT region, role, CAST(n AS BIGINT) AS n, CAST(CASE WHEN quota = 0 THEN 1 WHEN rich = 1 THEN quota - missing ELSE quota END AS BIGINT) AS quota FROM z""")
def quotas(spark, path):
    """Largest remainders; a role without a station takes one from the role with most. Three rows a region."""
    shares = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.lit(s).alias("share")) for r, s in (("train", 0.7), ("calibration", 0.1), ("test", 0.2)))))
    rows = src.stations(spark, path).groupBy(geo.region(F.col("latitude")).alias("region")).agg(F.count("*").alias("n")).select("region", "n", shares.alias("s")).select("region", "n", "s.*")
    by = Window.partitionBy("region")
    exact = F.col("n") * F.col("share")
    rows = rows.withColumn("base", F.floor(exact)).withColumn("spare", F.col("n") - F.sum("base").over(by)).withColumn("k", F.row_number().over(by.orderBy(F.desc(F.round(exact - F.col("base"), 9)), "role")))
    rows = rows.withColumn("quota", F.col("base") + F.when(F.col("k") <= F.col("spare"), 1).otherwise(0))
    rows = rows.withColumn("missing", F.sum(F.when(F.col("quota") == 0, 1).otherwise(0)).over(by)).withColumn("rich", F.row_number().over(by.orderBy(F.desc("quota"), "role")))
    quota = F.when(F.col("quota") == 0, 1).when(F.col("rich") == 1, F.col("quota") - F.col("missing")).otherwise(F.col("quota"))
    return rows.select("region", "role", "n", quota.cast("long").alias("quota"))


@query("RS3", f"""WITH {src.STATIONS_SQL}, o AS (SELECT station_no, CASE WHEN latitude >= 30 THEN 'north' WHEN latitude <= -30 THEN 'south' ELSE 'tropics' END AS region, CAST(floor((longitude + 180) / 60) AS BIGINT) AS sector, md5('3:' || station_no) AS jitter FROM stations),
p AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY sector, jitter, station_no) - 1 AS i FROM o) SELECT station_no, region, sector, CASE WHEN i % 10 IN (0, 1, 3, 4, 6, 7, 9) THEN 'train' WHEN i % 10 = 5 THEN 'calibration' ELSE 'test' END AS role FROM p""")
def sector_balanced(spark, path):
    """Roles follow each other in a fixed sequence along the sectors of a region, so each sector has its share."""
    rows = src.stations(spark, path).select("station_no", geo.region(F.col("latitude")).alias("region"), F.floor((F.col("longitude") + 180) / 60).alias("sector"), F.md5(F.concat(F.lit("3:"), F.col("station_no").cast("string"))).alias("jitter"))
    i = (F.row_number().over(Window.partitionBy("region").orderBy("sector", "jitter", "station_no")) - 1) % 10
    return rows.select("station_no", "region", "sector", F.when(i.isin(0, 1, 3, 4, 6, 7, 9), "train").when(i == 5, "calibration").otherwise("test").alias("role"))


@query("RS14", f"""WITH {src.STATIONS_SQL}, t AS (SELECT a.station_no AS target, b.station_no AS other, CAST('0x' || substr(md5('14:' || a.station_no || ':' || b.station_no), 1, 8) AS BIGINT) % 10 < 3 AS by_chance, floor((a.latitude + 90) / 30) = floor((b.latitude + 90) / 30) AND floor(a.longitude / 60) = floor(b.longitude / 60) AS same_block, abs(a.latitude - b.latitude) <= 10 AS near FROM stations a JOIN stations b ON a.station_no <> b.station_no)
SELECT target, count(*) FILTER (NOT by_chance) AS left_by_chance, count(*) FILTER (NOT same_block) AS left_by_block, count(*) FILTER (NOT near) AS left_by_distance FROM t GROUP BY 1""")
def masking(spark, path):
    """Context stations that stay by three policies. Stations are 120 at most."""
    s = src.stations(spark, path)
    a, b = (s.select(F.col("station_no").alias(n), F.col("latitude").alias(f"lat_{n}"), F.col("longitude").alias(f"lon_{n}")) for n in ("target", "other"))
    rows = a.join(F.broadcast(b), F.col("target") != F.col("other"))
    chance = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("14"), F.col("target").cast("string"), F.col("other").cast("string"))), 1, 8), 16, 10).cast("long") % 10 < 3
    block = lambda n: (F.floor((F.col(f"lat_{n}") + 90) / 30), F.floor(F.col(f"lon_{n}") / 60))
    (i, j), (k, m) = block("target"), block("other")
    near = F.abs(F.col("lat_target") - F.col("lat_other")) <= 10
    return rows.groupBy("target").agg(F.count_if(~chance).alias("left_by_chance"), F.count_if(~((i == k) & (j == m))).alias("left_by_block"), F.count_if(~near).alias("left_by_distance"))


@query("ML1", f"WITH {PRED}, h AS (SELECT {LEVEL}, month(time) AS m, hour(time) AS h, avg(residual_total) AS c FROM pred WHERE time < TIMESTAMP '{DEV}' GROUP BY ALL) SELECT {LEVEL}, count(*) AS n, round(sqrt(avg(pow(error, 2))), 6) AS by_month, round(sqrt(avg(pow(coalesce(c, correction) - residual_total, 2))), 6) AS by_hour FROM pred p LEFT JOIN h USING ({LEVEL}) WHERE h.m = month(p.time) AND h.h = hour(p.time) AND time >= TIMESTAMP '{DEV}' GROUP BY 1")
def climatology(spark, path):
    """Fitted before DEV, applied after it; cells are levels x months x two hours, so they are broadcast."""
    rows = predicted(spark, path).withColumn("m", F.month("time")).withColumn("h", F.hour("time"))
    at = F.lit(DEV).cast("timestamp")
    cells = rows.where(F.col("time") < at).groupBy(LEVEL, "m", "h").agg(F.avg("residual_total").alias("c"))
    e = F.col("c") - F.col("residual_total")
    new = rows.where(F.col("time") >= at).join(F.broadcast(cells), [LEVEL, "m", "h"])
    return new.groupBy(LEVEL).agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(F.col("error") * F.col("error"))), "by_month"), r6(F.sqrt(F.avg(e * e)), "by_hour"))


def ridge(rows: DataFrame, x1: Column, x2: Column, y: Column, by: str, penalty: float = 1.0) -> DataFrame:
    """by, n, b1, b2, b0 of ridge regression on two standardised features: normal equations from one aggregation."""
    s = rows.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("b0"), F.stddev_pop(x1).alias("s1"), F.stddev_pop(x2).alias("s2"),
        F.covar_pop(x1, x2).alias("c12"), F.covar_pop(x1, y).alias("c1"), F.covar_pop(x2, y).alias("c2"),
    )
    n, r, a, b = F.col("n"), F.col("c12") / (F.col("s1") * F.col("s2")), F.col("c1") / F.col("s1"), F.col("c2") / F.col("s2")
    one = 1 + penalty / n
    det = one * one - r * r
    return s.select(by, "n", "b0", "m1", "m2", "s1", "s2", ((one * a - r * b) / det).alias("b1"), ((one * b - r * a) / det).alias("b2"))


def ridge_sql(rows: str, x1: str, x2: str, y: str, by: str) -> str:
    return f"""(SELECT {by}, n, b0, m1, m2, s1, s2, ((1 + 1 / n) * a - r * b) / (pow(1 + 1 / n, 2) - r * r) AS b1, ((1 + 1 / n) * b - r * a) / (pow(1 + 1 / n, 2) - r * r) AS b2 FROM (SELECT {by}, count(*) AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS b0, stddev_pop({x1}) AS s1, stddev_pop({x2}) AS s2,
  covar_pop({x1}, {x2}) / (stddev_pop({x1}) * stddev_pop({x2})) AS r, covar_pop({x1}, {y}) / stddev_pop({x1}) AS a, covar_pop({x2}, {y}) / stddev_pop({x2}) AS b FROM {rows} GROUP BY 1))"""


_EARLY = f"(SELECT * FROM pred WHERE time < TIMESTAMP '{DEV}')"


@query("ML2", f"""WITH {PRED}, d AS {ridge_sql(_EARLY, 'bg_temperature_k', 'bg_q', 'residual_dry', LEVEL)}, w AS {ridge_sql(_EARLY, 'bg_temperature_k', 'bg_q', 'residual_wet', LEVEL)}
SELECT p.{LEVEL}, count(*) AS n, round(sqrt(avg(pow(d.b0 + d.b1 * (bg_temperature_k - d.m1) / d.s1 + d.b2 * (bg_q - d.m2) / d.s2 - residual_dry, 2))), 6) AS rmse_dry, round(sqrt(avg(pow(w.b0 + w.b1 * (bg_temperature_k - w.m1) / w.s1 + w.b2 * (bg_q - w.m2) / w.s2 - residual_wet, 2))), 6) AS rmse_wet
FROM pred p JOIN d ON d.{LEVEL} = p.{LEVEL} JOIN w ON w.{LEVEL} = p.{LEVEL} WHERE time >= TIMESTAMP '{DEV}' GROUP BY 1""")
def ridge_components(spark, path):
    """Dry and wet corrections by level from background temperature and humidity; six rows of coefficients are broadcast."""
    rows = predicted(spark, path)
    at = F.lit(DEV).cast("timestamp")
    t, q = F.col("bg_temperature_k"), F.col("bg_q")
    new, out = rows.where(F.col("time") >= at), []
    for part in ("dry", "wet"):
        fit = ridge(rows.where(F.col("time") < at), t, q, F.col(f"residual_{part}"), LEVEL)
        new = new.join(F.broadcast(fit.select(LEVEL, *(F.col(c).alias(f"{part}_{c}") for c in ("b0", "b1", "b2", "m1", "m2", "s1", "s2")))), LEVEL)
        c = lambda name, part=part: F.col(f"{part}_{name}")
        e = c("b0") + c("b1") * (t - c("m1")) / c("s1") + c("b2") * (q - c("m2")) / c("s2") - F.col(f"residual_{part}")
        out.append(r6(F.sqrt(F.avg(e * e)), f"rmse_{part}"))
    return new.groupBy(LEVEL).agg(F.count("*").alias("n"), *out)


@query("ML10", f"""WITH {src.SERIES_SQL}, n AS (SELECT *, row_number() OVER w AS i, lead(value, 2) OVER w AS y, avg(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM series WINDOW w AS (PARTITION BY station ORDER BY ts, event_id)), c AS (SELECT layer, avg(value) AS c FROM series GROUP BY 1)
SELECT count(*) AS n, round(sqrt(avg(pow(value - y, 2))), 6) AS persistence, round(sqrt(avg(pow(m - y, 2))), 6) AS recent_mean, round(sqrt(avg(pow(c - y, 2))), 6) AS climatology FROM n JOIN c USING (layer) WHERE y IS NOT NULL""")
def forecasts(spark, path):
    s = src.series(spark, path)
    by = Window.partitionBy("station").orderBy("ts", "event_id")
    rows = s.withColumn("y", F.lead("value", 2).over(by)).withColumn("m", F.avg("value").over(by.rowsBetween(-4, 0))).where("y IS NOT NULL").join(F.broadcast(s.groupBy("layer").agg(F.avg("value").alias("c"))), "layer")  # a row a layer
    rmse = lambda c, name: r6(F.sqrt(F.avg(F.pow(F.col(c) - F.col("y"), F.lit(2)))), name)
    return rows.agg(F.count("*").alias("n"), rmse("value", "persistence"), rmse("m", "recent_mean"), rmse("c", "climatology"))


@query("ML14", f"""WITH {_UNITS}, b AS (SELECT replicate, {_DELTA} AS x FROM {draws_sql('u', 'station_no', 140)} GROUP BY 1), t AS (SELECT sum(n) AS n, sqrt(sum(m) / sum(n)) AS rmse, sqrt(sum(g) / sum(n)) AS baseline FROM u)
SELECT CAST(t.n AS BIGINT) AS n, round(rmse, 6) AS rmse, round(baseline, 6) AS baseline, round(rmse - baseline, 6) AS delta, round((SELECT quantile_cont(x, 0.025) FROM b), 6) AS low, round((SELECT quantile_cont(x, 0.975) FROM b), 6) AS high FROM t""")
def model_summary(spark, path):
    u = sums(predicted(spark, path), "station_no")
    ends = draws(u, "station_no", 140).groupBy("replicate").agg(delta().alias("x")).agg(r6(F.percentile("x", F.lit(0.025)), "low"), r6(F.percentile("x", F.lit(0.975)), "high"))
    rms = lambda c: F.sqrt(F.sum(c) / F.sum("n"))
    return u.agg(F.sum("n").alias("n"), r6(rms("m"), "rmse"), r6(rms("g"), "baseline"), r6(rms("m") - rms("g"), "delta")).crossJoin(ends)  # one row each


_AT = 1000.0
_BRACKET = f"""{OBS}, s AS (SELECT profile_no, height_m AS lo, temperature_k AS a, tax AS sa, lead(height_m) OVER w AS hi, lead(temperature_k) OVER w AS b, lead(tax) OVER w AS sb FROM obs WHERE valid WINDOW w AS (PARTITION BY profile_no ORDER BY height_m, {LEVEL} DESC)),
br AS (SELECT *, ({d(_AT)} - lo) / (hi - lo) AS f FROM s WHERE hi > lo AND lo <= {d(_AT)} AND {d(_AT)} < hi)"""


def bracketed(spark, path) -> DataFrame:
    """The two valid levels around a height and the weight f of the upper one, at most one row a profile."""
    by = Window.partitionBy("profile_no").orderBy("height_m", F.desc(LEVEL))
    nxt = lambda c: F.lead(c).over(by)
    rows = observed(spark, path).where("valid").select("profile_no", F.col("height_m").alias("lo"), F.col("temperature_k").alias("a"), F.col("tax").alias("sa"), nxt("height_m").alias("hi"), nxt("temperature_k").alias("b"), nxt("tax").alias("sb"))
    return rows.where((F.col("hi") > F.col("lo")) & (F.col("lo") <= _AT) & (F.col("hi") > _AT)).withColumn("f", (F.lit(_AT) - F.col("lo")) / (F.col("hi") - F.col("lo")))


@query("AR3", f"WITH {_BRACKET} SELECT profile_no, round(1 - f, 6) AS lower_weight, round(f, 6) AS upper_weight, true AS supported FROM br")
def interpolation_weights(spark, path):
    return bracketed(spark, path).select("profile_no", r6(1 - F.col("f"), "lower_weight"), r6("f", "upper_weight"), F.lit(True).alias("supported"))


@query("AR4", f"WITH {_BRACKET} SELECT profile_no, round((1 - f) * a + f * b, 6) AS linear, round(exp((1 - f) * ln(a) + f * ln(b)), 6) AS log FROM br")
def weighted_value(spark, path):
    f, a, b = F.col("f"), F.col("a"), F.col("b")
    return bracketed(spark, path).select("profile_no", r6((1 - f) * a + f * b, "linear"), r6(F.exp((1 - f) * F.log(a) + f * F.log(b)), "log"))


@query("AR5", f"WITH {_BRACKET} SELECT profile_no, round(10000 * (pow(1 - f, 2) * sa * sa + f * f * sb * sb + 2 * f * (1 - f) * {d(0.6)} * sa * sb), 6) AS structured, round(10000 * (pow(1 - f, 2) * sa * sa + f * f * sb * sb), 6) AS diagonal FROM br")
def propagated_variance(spark, path):
    f, a, b = F.col("f"), F.col("sa"), F.col("sb")
    own = (1 - f) * (1 - f) * a * a + f * f * b * b
    return bracketed(spark, path).select("profile_no", r6(10000 * (own + 2 * f * (1 - f) * 0.6 * a * b), "structured"), r6(10000 * own, "diagonal"))


_GRID = (500.0, 1000.0, 2000.0, 4000.0, 8000.0)


@query("AR15", f"""WITH {OBS}, s AS (SELECT profile_no, height_m AS lo, temperature_k AS a, lead(height_m) OVER w AS hi, lead(temperature_k) OVER w AS b FROM obs WHERE valid WINDOW w AS (PARTITION BY profile_no ORDER BY height_m, {LEVEL} DESC))
SELECT profile_no, h AS height, round(a + (h - lo) / (hi - lo) * (b - a), 6) AS temperature_k FROM s, (SELECT unnest([{", ".join(d(h) for h in _GRID)}]) AS h) WHERE hi > lo AND lo <= h AND h < hi""")
def target_grid(spark, path):
    """Each segment lists the heights that it holds, so targets need no join."""
    by = Window.partitionBy("profile_no").orderBy("height_m", F.desc(LEVEL))
    rows = observed(spark, path).where("valid").select("profile_no", F.col("height_m").alias("lo"), F.col("temperature_k").alias("a"), F.lead("height_m").over(by).alias("hi"), F.lead("temperature_k").over(by).alias("b")).where("hi > lo")
    inside = F.filter(F.array(*(F.lit(h) for h in _GRID)), lambda h: (h >= F.col("lo")) & (h < F.col("hi")))
    rows = rows.withColumn("height", F.explode(inside))
    return rows.select("profile_no", "height", r6(F.col("a") + (F.col("height") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (F.col("b") - F.col("a")), "temperature_k"))


_W = "least(1, greatest(0, sum((y - b) * (a - b)) / greatest(sum((a - b) * (a - b)), 1e-12)))"
_CANDIDATES = f"{src.SERIES_SQL}, c AS (SELECT layer, value AS a, avg(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS b, lead(value, 1) OVER w AS y FROM series WINDOW w AS (PARTITION BY station ORDER BY ts, event_id)), k AS (SELECT * FROM c WHERE y IS NOT NULL)"


def candidates(spark, path) -> DataFrame:
    by = Window.partitionBy("station").orderBy("ts", "event_id")
    return src.series(spark, path).select("layer", F.col("value").alias("a"), F.avg("value").over(by.rowsBetween(-4, 0)).alias("b"), F.lead("value").over(by).alias("y")).where("y IS NOT NULL")


def ensemble_weight() -> Column:
    """Weight of candidate a against b by least squares, kept between 0 and 1."""
    a, b, y = F.col("a"), F.col("b"), F.col("y")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum((y - b) * (a - b)) / F.greatest(F.sum((a - b) * (a - b)), F.lit(1e-12))))


@query("AR11", f"WITH {_CANDIDATES} SELECT layer, round({_W}, 6) AS weight_persistence, round(1 - {_W}, 6) AS weight_mean, count(*) AS n FROM k GROUP BY 1")
def ensemble_weights(spark, path):
    return candidates(spark, path).groupBy("layer").agg(r6(ensemble_weight(), "weight_persistence"), r6(1 - ensemble_weight(), "weight_mean"), F.count("*").alias("n"))


@query("AR12", f"WITH {_CANDIDATES}, w AS (SELECT layer, {_W} AS w FROM k GROUP BY 1) SELECT layer, count(*) AS n, round(sqrt(avg(pow(w * a + (1 - w) * b - y, 2))), 6) AS rmse FROM k JOIN w USING (layer) GROUP BY 1")
def combined(spark, path):
    rows = candidates(spark, path)
    weights = rows.groupBy("layer").agg(ensemble_weight().alias("w"))  # a row a layer
    e = F.col("w") * F.col("a") + (1 - F.col("w")) * F.col("b") - F.col("y")
    return rows.join(F.broadcast(weights), "layer").groupBy("layer").agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(e * e)), "rmse"))


@query("AR13", f"""WITH {src.SERIES_SQL}, f AS (SELECT event_id, value AS p, unnest([1, 2, 3]) AS horizon, unnest([lead(value, 1) OVER w, lead(value, 2) OVER w, lead(value, 3) OVER w]) AS y FROM series WINDOW w AS (PARTITION BY station ORDER BY ts, event_id))
SELECT event_id, CAST(horizon AS INT) AS horizon, round(p, 6) AS prediction, round(y, 6) AS truth, round(p - y, 6) AS error FROM f WHERE y IS NOT NULL""")
def flattened(spark, path):
    by = Window.partitionBy("station").orderBy("ts", "event_id")
    wide = src.series(spark, path).select("event_id", F.col("value").alias("p"), F.array(*(F.lead("value", h).over(by) for h in (1, 2, 3))).alias("ys"))
    rows = wide.select("event_id", "p", F.posexplode("ys").alias("k", "y")).where("y IS NOT NULL")
    return rows.select("event_id", (F.col("k") + 1).alias("horizon"), r6("p", "prediction"), r6("y", "truth"), r6(F.col("p") - F.col("y"), "error"))


@query("JN14", f"""WITH {src.STATIONS_SQL}, v AS (SELECT station_no, cos(radians(latitude)) * cos(radians(longitude)) AS x, cos(radians(latitude)) * sin(radians(longitude)) AS y, sin(radians(latitude)) AS z FROM stations)
SELECT a.station_no AS target, round({d(6371.0088)} * 2 * asin(least(1, sqrt(min(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) / 2)), 6) AS nearest_km FROM v a JOIN v b ON a.station_no <> b.station_no GROUP BY 1""")
def nearest_by_chord(spark, path):
    s = src.stations(spark, path)
    unit = lambda lat, lon: (F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat)))
    squares = [F.pow(a - b, F.lit(2)) for a, b in zip(unit("latitude", "longitude"), unit("lat_b", "lon_b"), strict=True)]
    chord = F.sqrt(squares[0] + squares[1] + squares[2])
    return spatial.nearest(s, s, "station_no", 1).select("target", r6(geo.EARTH_KM * 2 * F.asin(F.least(F.lit(1.0), chord / 2)), "nearest_km"))


@query("JN16", f"WITH {PRED}, a AS (SELECT profile_no, {LEVEL}, correction AS m1 FROM pred), b AS (SELECT profile_no, {LEVEL}, correction / 2 AS m2 FROM pred WHERE tax > {d(0.01)}), c AS (SELECT profile_no, {LEVEL}, 0.0 AS m3 FROM pred WHERE profile_no % 5 <> 0) SELECT {LEVEL}, count(*) AS n, round(avg(m1), 6) AS m1, round(avg(m2), 6) AS m2, round(avg(m3), 6) AS m3 FROM a JOIN b USING (profile_no, {LEVEL}) JOIN c USING (profile_no, {LEVEL}) GROUP BY 1")
def wide_join(spark, path):
    """Three models of the same rows side by side: one aggregation by key instead of joins, kept where all three are there."""
    rows = predicted(spark, path)
    c = F.col("correction")
    models = F.array(F.struct(F.lit(1).alias("m"), c.alias("v")), F.when(F.col("tax") > 0.01, F.struct(F.lit(2).alias("m"), (c / 2).alias("v"))), F.when(F.col("profile_no") % 5 != 0, F.struct(F.lit(3).alias("m"), F.lit(0.0).alias("v"))))
    long = rows.select("profile_no", LEVEL, F.explode(models).alias("x")).where("x IS NOT NULL").select("profile_no", LEVEL, "x.*")
    wide = long.groupBy("profile_no", LEVEL).pivot("m", [1, 2, 3]).agg(F.first("v")).where("`1` IS NOT NULL AND `2` IS NOT NULL AND `3` IS NOT NULL")
    return wide.groupBy(LEVEL).agg(F.count("*").alias("n"), *(r6(F.avg(F.col(f"`{k}`")), f"m{k}") for k in (1, 2, 3)))


@query("JN24", f"""WITH {src.STATIONS_SQL}, b(block, south, west) AS (VALUES ('a', -90, -180), ('b', 0, -60), ('c', 30, 60)), r AS (SELECT block, station_no, latitude >= south AND latitude < south + 60 AND longitude >= west AND longitude < west + 120 AS inside, station_no % 3 AS k FROM stations, b)
SELECT block, CASE WHEN inside THEN 'evaluation' WHEN k = 0 THEN 'calibration' ELSE 'train' END AS role, count(*) AS n FROM r GROUP BY ALL""")
def block_roles(spark, path):
    """Three blocks, listed in each station's row."""
    a, o = F.col("latitude"), F.col("longitude")
    blocks = F.explode(F.array(*(F.struct(F.lit(b).alias("block"), ((a >= s) & (a < s + 60) & (o >= w) & (o < w + 120)).alias("inside")) for b, s, w in (("a", -90, -180), ("b", 0, -60), ("c", 30, 60)))))
    rows = src.stations(spark, path).select("station_no", blocks.alias("b")).select("station_no", "b.*")
    role = F.when(F.col("inside"), "evaluation").when(F.col("station_no") % 3 == 0, "calibration").otherwise("train")
    return rows.groupBy("block", role.alias("role")).agg(F.count("*").alias("n"))
