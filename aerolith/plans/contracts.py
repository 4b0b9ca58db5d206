"""Contracts, gates, audits, sinks and their scans, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.operators import ledger
from aerolith.plans.formulas import LEVEL
from aerolith.plans.registry import d, r6, registry
from aerolith.plans.soundings import OBS, PRED, observed, predicted
from aerolith.sources import levels as src
from aerolith.sources import text

Q, SQL, query = registry()


def checks(df: DataFrame, **found: Column) -> DataFrame:
    """check_name, passed, value: a row for each named (condition, value) over a table of one row."""
    rows = F.array(*(F.struct(F.lit(k).alias("check_name"), c["passed"].alias("passed"), c["value"].cast("double").alias("value")) for k, c in found.items()))
    return df.select(F.explode(rows).alias("c")).select("c.check_name", "c.passed", r6("c.value", "value"))


def check(passed: Column, value: Column) -> Column:
    return F.struct(passed.alias("passed"), value.alias("value"))


def _checks_sql(source: str, found: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS check_name, {p} AS passed, round(CAST({v} AS DOUBLE), 6) AS value FROM {source}" for k, (p, v) in found.items())


_DQ1 = {"not_empty": ("n > 0", "n"), "no_null_key": ("no_key = 0", "no_key"), "level_known": ("odd_level = 0", "odd_level"), "forbidden_absent": ("true", "0"), "required_present": ("true", "5")}


@query("DQ1", f"WITH {src.LEVELS_SQL}, one AS (SELECT count(*) AS n, count(*) FILTER (profile_no IS NULL) AS no_key, count(*) FILTER ({LEVEL} NOT IN (1000, 925, 850, 700, 500, 300)) AS odd_level FROM lv) {_checks_sql('one', _DQ1)}")
def schema_contract(spark, path):
    rows = src.levels(spark, path)
    wanted, unwanted = {"profile_no", "station_no", "time", LEVEL, "temperature_k"}, {"label", "truth"}
    one = rows.agg(F.count("*").alias("n"), F.count_if(F.col("profile_no").isNull()).alias("no_key"), F.count_if(~F.col(LEVEL).isin(*src.LEVELS)).alias("odd_level"))
    n = lambda c: F.col(c)
    return checks(
        one, not_empty=check(n("n") > 0, n("n")), no_null_key=check(n("no_key") == 0, n("no_key")), level_known=check(n("odd_level") == 0, n("odd_level")),
        forbidden_absent=check(F.lit(not unwanted & set(rows.columns)), F.lit(len(unwanted & set(rows.columns)))), required_present=check(F.lit(wanted <= set(rows.columns)), F.lit(len(wanted & set(rows.columns)))),
    )


_DQ3 = {"months": ("months >= 12", "months"), "stations": ("stations >= 50", "stations"), "southern": ("southern >= 5", "southern"), "complete_months": ("least >= 1", "least")}


@query("DQ3", f"""WITH {src.LEVELS_SQL}, m AS (SELECT date_trunc('month', time) AS m, count(*) AS n FROM lv GROUP BY 1), one AS (SELECT (SELECT count(*) FROM m) AS months, (SELECT min(n) FROM m) AS least, count(DISTINCT station_no) AS stations, count(DISTINCT station_no) FILTER (latitude < -30) AS southern FROM lv) {_checks_sql('one', _DQ3)}""")
def audit_roll_up(spark, path):
    rows = src.levels(spark, path)
    months = rows.groupBy(F.trunc("time", "month")).count().agg(F.count("*").alias("months"), F.min("count").alias("least"))
    one = rows.groupBy("station_no").agg(F.min("latitude").alias("latitude")).agg(F.count("*").alias("stations"), F.count_if(F.col("latitude") < -30).alias("southern")).crossJoin(months)  # one row each
    return checks(one, **{k: check(F.col(c) >= n, F.col(c)) for k, (c, n) in {"months": ("months", 12), "stations": ("stations", 50), "southern": ("southern", 5), "complete_months": ("least", 1)}.items()})


_RMSE = "sqrt(avg(error * error)) AS rmse, sqrt(avg(residual_total * residual_total)) AS base"


def rmse(c: str) -> Column:
    return F.sqrt(F.avg(F.col(c) * F.col(c)))


_DQ7 = {"wins": ("wins >= 4", "wins"), "coverage": (f"coverage BETWEEN {d(0.87)} AND {d(0.93)}", "coverage")}


@query("DQ7", f"""WITH {PRED}, s AS (SELECT {LEVEL}, sqrt(avg(error * error)) < sqrt(avg(residual_total * residual_total)) AS win, count(*) AS n, count(*) FILTER (abs(error) <= sd * {d(1.64485362695147)}) AS inside FROM pred GROUP BY 1),
one AS (SELECT count(*) FILTER (win) AS wins, sum(inside) / sum(n) AS coverage FROM s) {_checks_sql('one', _DQ7)}""")
def probability_gate(spark, path):
    s = predicted(spark, path).groupBy(LEVEL).agg((rmse("error") < rmse("residual_total")).alias("win"), F.count("*").alias("n"), F.count_if(F.abs("error") <= F.col("sd") * 1.64485362695147).alias("inside"))
    one = s.agg(F.count_if("win").alias("wins"), (F.sum("inside") / F.sum("n")).alias("coverage"))
    return checks(one, wins=check(F.col("wins") >= 4, F.col("wins")), coverage=check(F.col("coverage").between(0.87, 0.93), F.col("coverage")))


_DQ8 = {"upper_below_zero": ("upper < 0", "upper"), "within_one_percent": (f"rmse <= base * {d(1.01)}", "rmse - base")}


@query("DQ8", f"""WITH {PRED}, s AS (SELECT station_no, {_RMSE} FROM pred GROUP BY 1), u AS (SELECT avg(rmse - base) + {d(1.96)} * stddev_samp(rmse - base) / sqrt(count(*)) AS upper FROM s), one AS (SELECT upper, (SELECT sqrt(avg(error * error)) FROM pred) AS rmse, (SELECT sqrt(avg(residual_total * residual_total)) FROM pred) AS base FROM u) {_checks_sql('one', _DQ8)}""")
def point_gate(spark, path):
    """Station sums carry the pooled figures too, so rows are read once."""
    e, g = F.col("error"), F.col("residual_total")
    s = predicted(spark, path).groupBy("station_no").agg(F.count("*").alias("n"), F.sum(e * e).alias("m"), F.sum(g * g).alias("b"))
    x = F.sqrt(F.col("m") / F.col("n")) - F.sqrt(F.col("b") / F.col("n"))
    one = s.agg((F.avg(x) + 1.96 * F.stddev_samp(x) / F.sqrt(F.count("*"))).alias("upper"), F.sqrt(F.sum("m") / F.sum("n")).alias("rmse"), F.sqrt(F.sum("b") / F.sum("n")).alias("base"))
    return checks(one, upper_below_zero=check(F.col("upper") < 0, F.col("upper")), within_one_percent=check(F.col("rmse") <= F.col("base") * 1.01, F.col("rmse") - F.col("base")))


_DQ9 = {"paired_wins": ("wins * 2 > n", "wins"), "non_inferior": (f"delta <= {d(0.02)}", "delta")}


@query("DQ9", f"WITH {PRED}, s AS (SELECT month(time) AS m, {_RMSE} FROM pred GROUP BY 1), one AS (SELECT count(*) AS n, count(*) FILTER (rmse < base) AS wins, avg(rmse - base) AS delta FROM s) {_checks_sql('one', _DQ9)}")
def selection_gate(spark, path):
    s = predicted(spark, path).groupBy(F.month("time").alias("m")).agg(rmse("error").alias("rmse"), rmse("residual_total").alias("base"))
    one = s.agg(F.count("*").alias("n"), F.count_if(F.col("rmse") < F.col("base")).alias("wins"), F.avg(F.col("rmse") - F.col("base")).alias("delta"))
    return checks(one, paired_wins=check(F.col("wins") * 2 > F.col("n"), F.col("wins")), non_inferior=check(F.col("delta") <= 0.02, F.col("delta")))


_DQ10 = {
    "leave_one_sign": ("NOT flips", "CASE WHEN flips THEN 1 ELSE 0 END"), "row_share": (f"share <= {d(0.25)}", "share"), "year_sign": ("signs = 1", "signs"), "year_difference": (f"spread <= {d(0.5)}", "spread"),
    "excess_departure": (f"depart <= {d(0.5)}", "depart"), "interval_excludes_zero": ("apart", "CASE WHEN apart THEN 1 ELSE 0 END"),
}


@query("DQ10", f"""WITH {PRED}, s AS (SELECT station_no, count(*) AS n, sum(error * error) AS m, sum(residual_total * residual_total) AS b FROM pred GROUP BY 1), t AS (SELECT sum(n) AS n, sum(m) AS m, sum(b) AS b FROM s),
l AS (SELECT s.n / t.n AS share, sqrt(t.m / t.n) - sqrt(t.b / t.n) AS whole, sqrt((t.m - s.m) / (t.n - s.n)) - sqrt((t.b - s.b) / (t.n - s.n)) AS rest, sqrt(s.m / s.n) - sqrt(s.b / s.n) AS own FROM s, t),
y AS (SELECT year(time) AS y, sqrt(avg(error * error)) - sqrt(avg(residual_total * residual_total)) AS x FROM pred GROUP BY 1), g AS (SELECT count(DISTINCT sign(x)) AS signs, max(x) - min(x) AS spread FROM y),
one AS (SELECT bool_or(sign(rest) <> sign(whole)) AS flips, max(share) AS share, max(abs(rest - whole)) AS depart, abs(avg(own)) > {d(1.96)} * stddev_samp(own) / sqrt(count(*)) AS apart, any_value(signs) AS signs, any_value(spread) AS spread FROM l, g) {_checks_sql('one', _DQ10)}""")
def sampling_gate(spark, path):
    """Stations and years are few rows each; their totals are joined as one row."""
    e, g = F.col("error"), F.col("residual_total")
    cells = predicted(spark, path).groupBy("station_no", F.year("time").alias("y")).agg(F.count("*").alias("n"), F.sum(e * e).alias("m"), F.sum(g * g).alias("b"))
    delta = lambda n, m, b: F.sqrt(m / n) - F.sqrt(b / n)
    three = [F.sum(c).alias(c) for c in ("n", "m", "b")]
    s, c = cells.groupBy("station_no").agg(*three), F.col
    t = s.agg(F.sum("n").alias("tn"), F.sum("m").alias("tm"), F.sum("b").alias("tb"))
    x = delta(c("n"), c("m"), c("b"))
    years = cells.groupBy("y").agg(*three).agg(F.count_distinct(F.signum(x)).alias("signs"), (F.max(x) - F.min(x)).alias("spread"))
    whole, rest = delta(c("tn"), c("tm"), c("tb")), delta(c("tn") - c("n"), c("tm") - c("m"), c("tb") - c("b"))
    one = s.crossJoin(F.broadcast(t)).agg(
        F.bool_or(F.signum(rest) != F.signum(whole)).alias("flips"), F.max(c("n") / c("tn")).alias("share"), F.max(F.abs(rest - whole)).alias("depart"), (F.abs(F.avg(x)) > 1.96 * F.stddev_samp(x) / F.sqrt(F.count("*"))).alias("apart")
    ).crossJoin(years)
    return checks(
        one, leave_one_sign=check(~c("flips"), c("flips").cast("int")), row_share=check(c("share") <= 0.25, c("share")), year_sign=check(c("signs") == 1, c("signs")), year_difference=check(c("spread") <= 0.5, c("spread")),
        excess_departure=check(c("depart") <= 0.5, c("depart")), interval_excludes_zero=check(c("apart"), c("apart").cast("int")),
    )


_DQ11 = {"point": ("rmse <= base", "rmse - base"), "spread": (f"coverage >= {d(0.5)}", "coverage"), "all": (f"rmse <= base AND coverage >= {d(0.5)}", "1")}


@query("DQ11", f"WITH {PRED}, one AS (SELECT {_RMSE}, avg(CASE WHEN abs(error) <= sd * {d(1.64485362695147)} THEN 1.0 ELSE 0.0 END) AS coverage FROM pred) {_checks_sql('one', _DQ11)}")
def combined_gate(spark, path):
    one = predicted(spark, path).agg(rmse("error").alias("rmse"), rmse("residual_total").alias("base"), F.avg((F.abs("error") <= F.col("sd") * 1.64485362695147).cast("double")).alias("coverage"))
    a, b = F.col("rmse") <= F.col("base"), F.col("coverage") >= 0.5
    return checks(one, point=check(a, F.col("rmse") - F.col("base")), spread=check(b, F.col("coverage")), all=check(a & b, F.lit(1)))


@query("DQ12", f"""WITH {PRED}, a AS (SELECT {LEVEL}, sqrt(avg(error * error)) AS x FROM pred GROUP BY 1), b AS (SELECT {LEVEL}, sqrt(sum(ss) / sum(n)) AS x FROM (SELECT {LEVEL}, station_no, count(*) AS n, sum(error * error) AS ss FROM pred GROUP BY ALL) GROUP BY 1)
SELECT {LEVEL}, abs(a.x - b.x) <= {d(1e-9)} AS consistent, round(a.x, 6) AS rmse FROM a JOIN b USING ({LEVEL})""")
def evidence_consistency(spark, path):
    """The same figure from rows and from station tables."""
    rows = predicted(spark, path)
    a = rows.groupBy(LEVEL).agg(rmse("error").alias("x"))
    s = rows.groupBy(LEVEL, "station_no").agg(F.count("*").alias("n"), F.sum(F.col("error") * F.col("error")).alias("ss")).groupBy(LEVEL).agg(F.sqrt(F.sum("ss") / F.sum("n")).alias("y"))
    return a.join(s, LEVEL).select(LEVEL, (F.abs(F.col("x") - F.col("y")) <= 1e-9).alias("consistent"), r6("x", "rmse"))


@query("DQ14", f"""WITH {PRED}, m AS (SELECT {LEVEL}, sqrt(avg(error * error)) - sqrt(avg(residual_total * residual_total)) AS m1, sqrt(avg(pow(correction * 2 - residual_total, 2))) - sqrt(avg(residual_total * residual_total)) AS m2 FROM pred GROUP BY 1),
w AS (SELECT {LEVEL}, CASE WHEN m1 < -{d(0.01)} THEN 'improves' WHEN m1 > {d(0.01)} THEN 'degrades' ELSE 'neutral' END AS first, CASE WHEN m2 < -{d(0.01)} THEN 'improves' WHEN m2 > {d(0.01)} THEN 'degrades' ELSE 'neutral' END AS second FROM m)
SELECT {LEVEL}, first, second, first <> second AND first <> 'neutral' AND second <> 'neutral' AS opposite FROM w""")
def directions(spark, path):
    g = rmse("residual_total")
    twice = 2 * F.col("correction") - F.col("residual_total")
    m = predicted(spark, path).groupBy(LEVEL).agg((rmse("error") - g).alias("m1"), (F.sqrt(F.avg(twice * twice)) - g).alias("m2"))
    word = lambda c: F.when(F.col(c) < -0.01, "improves").when(F.col(c) > 0.01, "degrades").otherwise("neutral")
    w = m.select(LEVEL, word("m1").alias("first"), word("m2").alias("second"))
    return w.withColumn("opposite", (F.col("first") != F.col("second")) & (F.col("first") != "neutral") & (F.col("second") != "neutral"))


_DQ16 = {"finite": ("odd = 0", "odd"), "positive_spread": ("flat = 0", "flat"), "pooled": (f"abs(pooled - direct) <= {d(1e-9)}", "pooled"), "levels_complete": ("levels = 6", "levels")}


@query("DQ16", f"""WITH {PRED}, l AS (SELECT {LEVEL}, count(*) AS n, sqrt(avg(error * error)) AS r, count(*) FILTER (NOT isfinite(error)) AS odd, count(*) FILTER (NOT sd > 0) AS flat, sum(error * error) AS ss FROM pred GROUP BY 1),
one AS (SELECT sum(odd) AS odd, sum(flat) AS flat, sqrt(sum(n * r * r) / sum(n)) AS pooled, sqrt(sum(ss) / sum(n)) AS direct, count(*) AS levels FROM l) {_checks_sql('one', _DQ16)}""")
def numeric_check(spark, path):
    e = F.col("error")
    l = predicted(spark, path).groupBy(LEVEL).agg(F.count("*").alias("n"), rmse("error").alias("r"), F.count_if(F.isnan(e) | (F.abs(e) == float("inf"))).alias("odd"), F.count_if(~(F.col("sd") > 0)).alias("flat"), F.sum(e * e).alias("ss"))  # noqa: E741
    c = F.col
    one = l.agg(F.sum("odd").alias("odd"), F.sum("flat").alias("flat"), F.sqrt(F.sum(c("n") * c("r") * c("r")) / F.sum("n")).alias("pooled"), F.sqrt(F.sum("ss") / F.sum("n")).alias("direct"), F.count("*").alias("levels"))
    return checks(one, finite=check(c("odd") == 0, c("odd")), positive_spread=check(c("flat") == 0, c("flat")), pooled=check(F.abs(c("pooled") - c("direct")) <= 1e-9, c("pooled")), levels_complete=check(c("levels") == 6, c("levels")))


@query("DQ17", f"""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT strftime(x, '%Y-%m') AS m FROM range(TIMESTAMP '1995-01-01', TIMESTAMP '2001-01-01', INTERVAL 1 MONTH) r(x)) SELECT k.m AS month, m.n IS NOT NULL AS present, coalesce(m.n, 0) AS n FROM k LEFT JOIN m USING (m)""")
def preconditions(spark, path):
    """Which months of the period have input."""
    have = src.table(spark, path, "orders", "o_orderdate").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    want = spark.range(1).select(F.explode(F.expr("sequence(DATE'1995-01-01', DATE'2000-12-01', INTERVAL 1 MONTH)")).alias("d")).select(F.date_format("d", "yyyy-MM").alias("month"))
    return want.join(have, "month", "left").select("month", F.col("n").isNotNull().alias("present"), F.coalesce("n", F.lit(0)).alias("n"))


@query("DQ18", f"""WITH {PRED}, v AS (SELECT {LEVEL}, unnest(['A', 'B']) AS variant, unnest([error, correction * 3 - residual_total]) AS e, residual_total AS g FROM pred), s AS (SELECT {LEVEL}, variant, sqrt(avg(e * e)) - sqrt(avg(g * g)) AS x FROM v GROUP BY ALL)
SELECT {LEVEL}, count(DISTINCT sign(x)) > 1 AS sign_differs, round(max(x) FILTER (variant = 'A'), 6) AS a, round(max(x) FILTER (variant = 'B'), 6) AS b FROM s GROUP BY 1""")
def sign_review(spark, path):
    g = F.col("residual_total")
    each = F.explode(F.array(F.struct(F.lit("A").alias("variant"), F.col("error").alias("e")), F.struct(F.lit("B").alias("variant"), (F.col("correction") * 3 - g).alias("e"))))
    s = predicted(spark, path).select(LEVEL, g.alias("g"), each.alias("v")).groupBy(LEVEL, "v.variant").agg((F.sqrt(F.avg(F.col("v.e") * F.col("v.e"))) - F.sqrt(F.avg(F.col("g") * F.col("g")))).alias("x"))
    at = lambda k: F.max(F.when(F.col("variant") == k, F.col("x")))
    return s.groupBy(LEVEL).agg((F.count_distinct(F.signum("x")) > 1).alias("sign_differs"), r6(at("A"), "a"), r6(at("B"), "b"))




@query("AG30", f"WITH {OBS}, t AS (SELECT {LEVEL}, residual_dry AS dry, residual_wet AS wet FROM obs WHERE valid) SELECT {LEVEL}, round(avg(dry), 6) AS mean_dry, round(avg(wet), 6) AS mean_wet, round(avg(dry * dry), 6) AS mse_dry, round(avg(wet * wet), 6) AS mse_wet, round(2 * avg(dry * wet), 6) AS cross_term, round(max(abs(dry)), 6) AS most_dry, round(max(abs(wet)), 6) AS most_wet FROM t GROUP BY 1")
def attribution_summary(spark, path):
    a, b = F.col("residual_dry"), F.col("residual_wet")
    return observed(spark, path).where("valid").groupBy(LEVEL).agg(r6(F.avg(a), "mean_dry"), r6(F.avg(b), "mean_wet"), r6(F.avg(a * a), "mse_dry"), r6(F.avg(b * b), "mse_wet"), r6(2 * F.avg(a * b), "cross_term"), r6(F.max(F.abs(a)), "most_dry"), r6(F.max(F.abs(b)), "most_wet"))


@query("AG34", f"""WITH {OBS}, v AS (SELECT profile_no, {LEVEL}, unnest(['A', 'B', 'C']) AS variant, valid AND NOT below_ground AS base, unnest([valid AND NOT below_ground, valid, valid AND NOT below_ground AND tax > {d(0.01)}]) AS ok FROM obs)
SELECT variant, count(*) AS inputs, count(*) FILTER (ok) AS valid, count(*) FILTER (ok AND base) AS common, count(*) FILTER (ok AND NOT base) AS added, count(*) FILTER (base AND NOT ok) AS removed, count(*) FILTER (ok) = count(*) FILTER (ok AND base) + count(*) FILTER (ok AND NOT base) AS closes FROM v GROUP BY 1""")
def mask_accounting(spark, path):
    """All variants of a row stand beside each other, so nothing is joined."""
    base = F.col("valid") & ~F.col("below_ground")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), ok.alias("ok")) for k, ok in (("A", base), ("B", F.col("valid")), ("C", base & (F.col("tax") > 0.01))))))
    rows = observed(spark, path).select(base.alias("base"), each.alias("v")).select("base", "v.*")
    n = F.count_if
    ok, b = F.col("ok"), F.col("base")
    return rows.groupBy("variant").agg(F.count("*").alias("inputs"), n(ok).alias("valid"), n(ok & b).alias("common"), n(ok & ~b).alias("added"), n(b & ~ok).alias("removed"), (n(ok) == n(ok & b) + n(ok & ~b)).alias("closes"))


@query("AG36", f"WITH {OBS} SELECT {LEVEL}, round(avg(bg_temperature_k), 6) AS mean_t, round(stddev_pop(bg_temperature_k), 6) AS sd_t, round(1000 * avg(bg_q), 6) AS mean_q, round(1000 * stddev_pop(bg_q), 6) AS sd_q, round(quantile_cont(dewpoint_depression_c, 0.5), 6) AS fill, round(min(bg_temperature_k), 6) AS low, round(max(bg_temperature_k), 6) AS high FROM obs WHERE time < TIMESTAMP '1999-01-01' GROUP BY 1")
def standardisation(spark, path):
    t, q = F.col("bg_temperature_k"), F.col("bg_q")
    rows = observed(spark, path).where(F.col("time") < F.lit("1999-01-01").cast("timestamp"))
    return rows.groupBy(LEVEL).agg(r6(F.avg(t), "mean_t"), r6(F.stddev_pop(t), "sd_t"), r6(1000 * F.avg(q), "mean_q"), r6(1000 * F.stddev_pop(q), "sd_q"), r6(F.median("dewpoint_depression_c"), "fill"), r6(F.min(t), "low"), r6(F.max(t), "high"))


@query("AG41", f"""WITH {PRED}, s AS (SELECT 'levels' AS source, 'station' AS unit, count(*) AS n, count(DISTINCT station_no) AS units, {_RMSE} FROM pred UNION ALL SELECT 'late', 'month', count(*), count(DISTINCT month(time)), {_RMSE} FROM pred WHERE time >= TIMESTAMP '1999-01-01' UNION ALL SELECT 'upper', 'profile', count(*), count(DISTINCT profile_no), {_RMSE} FROM pred WHERE {LEVEL} <= 500)
SELECT source, unit, n, units, round(rmse, 6) AS rmse, round(base, 6) AS base FROM s""")
def platform_comparison(spark, path):
    rows, out = predicted(spark, path), None
    for source, unit, some, key in (("levels", "station", rows, F.col("station_no")), ("late", "month", rows.where(F.col("time") >= F.lit("1999-01-01").cast("timestamp")), F.month("time")), ("upper", "profile", rows.where(F.col(LEVEL) <= 500), F.col("profile_no"))):
        one = some.agg(F.lit(source).alias("source"), F.lit(unit).alias("unit"), F.count("*").alias("n"), F.count_distinct(key).alias("units"), r6(rmse("error"), "rmse"), r6(rmse("residual_total"), "base"))
        out = one if out is None else out.unionByName(one)
    return out


@query("AG4", f"""WITH {src.SERIES_SQL}, f AS (SELECT layer, station % 10 AS station, h AS horizon, value - lead(value, CAST(h AS INT)) OVER (PARTITION BY station, h ORDER BY ts, event_id) AS e FROM series, (SELECT unnest([1, 2]) AS h))
SELECT coalesce(layer, 'all') AS layer, coalesce(CAST(horizon AS VARCHAR), 'all') AS horizon, coalesce(CAST(station AS VARCHAR), 'all') AS station, count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(avg(e), 6) AS bias FROM f WHERE e IS NOT NULL GROUP BY GROUPING SETS ((layer, horizon), (layer), (horizon), (station), ())""")
def site_scopes(spark, path):
    from pyspark.sql import Window

    by = Window.partitionBy("station").orderBy("ts", "event_id")
    each = F.array(*(F.struct(F.lit(h).alias("horizon"), (F.col("value") - F.lead("value", h).over(by)).alias("e")) for h in (1, 2)))
    rows = src.series(spark, path).select("layer", (F.col("station") % 10).alias("station"), each.alias("es")).select("layer", "station", F.explode("es").alias("x")).select("layer", "station", "x.*").where("e IS NOT NULL")
    layer, horizon, station, e = F.col("layer"), F.col("horizon"), F.col("station"), F.col("e")
    out = rows.groupingSets([[layer, horizon], [layer], [horizon], [station], []], layer, horizon, station).agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(e * e)), "rmse"), r6(F.avg(F.abs(e)), "mae"), r6(F.avg(e), "bias"))
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("all")) for c in ("layer", "horizon", "station")})


@query("SC5", f"""WITH {src.LEVELS_SQL} SELECT station_no, count(*) AS n, round(avg(height_m), 6) AS height_m, CASE WHEN station_no % 40 = 39 THEN 'missing_column' ELSE 'retained' END AS reason FROM lv GROUP BY 1""")
def station_files(spark, path):
    """One CSV folder a station, its id from the path; files without a required column are audited, not read."""
    rows = src.levels(spark, path).select("station_no", "profile_no", F.col(LEVEL), "height_m").withColumn("station", F.lpad(F.col("station_no").cast("string"), 5, "0"))
    folder = text.scratch(spark, "csv")
    bad = F.col("station_no") % 40 == 39
    for name, some in (("good", rows.where(~bad)), ("bad", rows.where(bad).withColumnRenamed(LEVEL, "level"))):
        some.drop("station_no").repartition("station").write.partitionBy("station").option("header", True).csv(f"{folder}/{name}")
    lines = spark.read.text([f"{folder}/good", f"{folder}/bad"], recursiveFileLookup=True).select(F.regexp_extract(F.col("_metadata.file_path"), "station=([0-9]+)", 1).cast("long").alias("station_no"), "value", F.col("_metadata.file_path").alias("file"))
    heads = lines.where("value LIKE 'profile_no,%'").select("file", F.col("value").contains(LEVEL).alias("ok")).distinct()
    data = lines.where("value NOT LIKE 'profile_no,%'").join(heads, "file")
    return data.groupBy("station_no").agg(F.count("*").alias("n"), r6(F.avg(F.split("value", ",")[2].cast("double")), "height_m"), F.when(F.bool_and("ok"), "retained").otherwise("missing_column").alias("reason"))


@query("SC7", """WITH g AS (SELECT date_trunc('month', o_orderdate) AS m, min(o_orderdate) AS low, max(o_orderdate) AS high FROM orders GROUP BY 1), w AS (SELECT m, coalesce(lag(high) OVER (ORDER BY m), low) AS low, coalesce(lead(low) OVER (ORDER BY m), high) AS high FROM g),
t AS (SELECT date_trunc('month', l_shipdate) AS m, l_shipdate AS t FROM lineitem) SELECT strftime(t.m, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (t.t BETWEEN w.low AND w.high) AS bracketed FROM t JOIN w ON w.m = t.m GROUP BY 1""")
def boundaries(spark, path):
    """A month's slices with the nearest slice of each neighbour; targets outside are counted, not extrapolated. Months are few."""
    from pyspark.sql import Window

    by = Window.orderBy("m")
    g = src.table(spark, path, "orders", "o_orderdate").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    w = g.select("m", F.coalesce(F.lag("b").over(by), "a").alias("low"), F.coalesce(F.lead("a").over(by), "b").alias("high"))
    t = src.table(spark, path, "lineitem", "l_shipdate").withColumn("m", F.date_trunc("month", "l_shipdate"))
    return t.join(F.broadcast(w), "m").groupBy(F.date_format("m", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count_if(F.col("l_shipdate").between(F.col("low"), F.col("high"))).alias("bracketed"))


@query("SC8", f"""WITH {PRED}, s AS (SELECT pressure_flag AS run, {LEVEL}, count(*) AS n, sqrt(avg(error * error)) AS rmse, avg(CASE WHEN pressure_flag <> 'A' THEN error END) AS bias FROM pred GROUP BY ALL) SELECT run, count(*) AS rows, round(avg(rmse), 6) AS rmse, round(avg(bias), 6) AS bias FROM s GROUP BY 1""")
def metric_files(spark, path):
    """A file a run, one of them without a column and one without rows, read together and tagged by path."""
    rows = predicted(spark, path).groupBy(F.col("pressure_flag").alias("run"), LEVEL).agg(F.count("*").alias("n"), rmse("error").alias("rmse"), F.avg("error").alias("bias"))
    folder = text.scratch(spark, "metrics")
    rows.withColumn("bias", F.when(F.col("run") != "A", F.col("bias"))).repartition("run").write.partitionBy("run").json(folder)  # a null isn't written, so A's file lacks the column
    rows.limit(0).drop("run").coalesce(1).write.json(f"{folder}/run=none")
    schema = f"{LEVEL} long, n long, rmse double, bias double"
    found = spark.read.schema(schema).json([f"{folder}/run={r}" for r in ("A", "N", "R", "none")])
    run = F.regexp_extract(F.col("_metadata.file_path"), "run=([A-Za-z]+)/", 1)
    return found.groupBy(run.alias("run")).agg(F.count("*").alias("rows"), r6(F.avg("rmse"), "rmse"), r6(F.avg("bias"), "bias"))


@query("SC9", f"WITH {src.LEVELS_SQL} SELECT CAST(year(time) AS BIGINT) AS year, CAST(month(time) AS BIGINT) AS month, count(*) AS n, round(sum(height_m), 4) AS height_m FROM lv GROUP BY ALL")
def partitioned_sink(spark, path):
    """Zstandard Parquet by year and month; each month's rows are dealt to one writer, and a month written again replaces itself."""
    rows = src.levels(spark, path).select("profile_no", LEVEL, "height_m", F.year("time").alias("year"), F.month("time").alias("month"))
    folder = text.scratch(spark, "sink")
    sink = lambda df: df.repartition("year", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year", "month").parquet(folder)
    sink(rows)
    sink(rows.where("year = 1997 AND month = 6"))
    return spark.read.parquet(folder).groupBy(F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("height_m"), 4).alias("height_m"))


@query("SC10", f"WITH {PRED} SELECT {LEVEL}, count(*) AS n, round(sqrt(avg(error * error)), 6) AS rmse FROM pred GROUP BY 1")
def text_sinks(spark, path):
    """A metric table as CSV and as JSON, read again and compared."""
    rows = predicted(spark, path).groupBy(LEVEL).agg(F.count("*").alias("n"), r6(rmse("error"), "rmse"))
    folder, schema = text.scratch(spark, "results"), f"{LEVEL} int, n long, rmse double"
    rows.coalesce(1).write.option("header", True).csv(f"{folder}/csv")
    a = spark.read.schema(schema).option("header", True).csv(f"{folder}/csv")
    a.write.json(f"{folder}/json")
    b = spark.read.schema(schema).json(f"{folder}/json")
    return a.intersect(b)


@query("SC11", f"WITH {src.LEVELS_SQL}, p AS (SELECT strftime(time, '%Y') AS year, profile_no, count(*) AS n, avg(tax) AS tax FROM lv GROUP BY ALL) SELECT year, CAST(sum(n) AS BIGINT) AS n, count(*) AS profiles, round(avg(tax), 6) AS tax FROM p GROUP BY 1")
def incremental(spark, path):
    """A first run over the older months, one of them not as it is today; the second makes what is new or changed, the third nothing."""
    rows = src.levels(spark, path).select("profile_no", "pressure_hpa", "tax", F.date_format("time", "yyyy-MM").alias("month"))
    folder = text.scratch(spark, "months")
    job = lambda df: df.groupBy("month", "profile_no").agg(F.count("*").alias("n"), F.avg("tax").alias("tax"))
    before = rows.where("month < '1998-01'").withColumn("tax", F.when(F.col("month") == "1996-03", F.col("tax") + 1).otherwise(F.col("tax")))
    for df in (before, rows, rows):
        ledger.run(df, "month", job, {"job": "profile means", "version": 1}, folder)
    return ledger.results(spark, folder).groupBy(F.substring("month", 1, 4).alias("year")).agg(F.sum("n").alias("n"), F.count("*").alias("profiles"), r6(F.avg("tax"), "tax"))


@query("SC12", f"WITH {src.STATIONS_SQL} SELECT count(*) AS n, md5(string_agg(md5(station_no || ':' || CAST(latitude AS BIGINT) || ':' || CAST(longitude AS BIGINT)), '' ORDER BY station_no)) AS fingerprint, CAST(sum(CAST('0x' || substr(md5(CAST(station_no AS VARCHAR)), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM stations")
def fingerprint(spark, path):
    """Ordered for the small station list; the checksum needs no order and fits tables of any size."""
    key = F.concat_ws(":", F.col("station_no").cast("string"), F.col("latitude").cast("long").cast("string"), F.col("longitude").cast("long").cast("string"))
    rows = src.stations(spark, path).select("station_no", F.md5(key).alias("h"), F.conv(F.substring(F.md5(F.col("station_no").cast("string")), 1, 8), 16, 10).cast("long").alias("k"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("station_no", "h"))), lambda s: s["h"])
    return rows.agg(F.count("*").alias("n"), F.md5(F.array_join(listed, "")).alias("fingerprint"), F.sum("k").alias("checksum"))
