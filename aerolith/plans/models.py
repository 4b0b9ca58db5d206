"""Boosted, linear and scale models over sounding rows and series; those that SQL can repeat have a twin."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import feature_sets, scores
from aerolith.models import boosting, linear, spread
from aerolith.operators import checks, sequences
from aerolith.operators.quantiles import quantiles
from aerolith.plans.formulas import LEVEL
from aerolith.plans.registry import d, r6, registry
from aerolith.plans.soundings import CAL, DEV, OBS, PRED, observed, predicted
from aerolith.sources import levels as src
from aerolith.sources.text import staged

Q, SQL, query = registry()
Z90 = scores.QUANTILES[0.9]


def unmatched(key: str):
    """Registers a query that SQL can't repeat; its test holds it against a plain version."""

    def put(f):
        Q[key] = f
        return f

    return put


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def rmse(e: Column) -> Column:
    return F.sqrt(F.avg(e * e))


# Feature sets

_TURN = d(2 * math.pi)
_MAPPING = {
    "n_bg": "bg_total", "t_bg": "bg_temperature_k", "q_bg": "bg_q", "height_km": f"height_m / {d(1000.0)}", "lat_norm": f"latitude / {d(90.0)}", "lon_sin": "sin(radians(longitude))", "lon_cos": "cos(radians(longitude))",
    "doy_sin": f"sin(dayofyear(time) * {_TURN} / 366)", "doy_cos": f"cos(dayofyear(time) * {_TURN} / 366)", "hour_sin": f"sin(hour(time) * {_TURN} / 24)", "hour_cos": f"cos(hour(time) * {_TURN} / 24)", "layer_norm": f"{LEVEL} / {d(1000.0)}",
    "day_sin": f"sin((dayofyear(time) - 1) * {_TURN} / 366)", "day_cos": f"cos((dayofyear(time) - 1) * {_TURN} / 366)",
}


@query("SF13b", f"WITH {OBS} SELECT profile_no, {LEVEL}, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _MAPPING.items()) + " FROM obs")
def other_features(spark, path):
    """Mapping, multi-site and single-site features of each row."""
    sets = feature_sets.mapping(level=True) | feature_sets.calendar_from_zero(F.col("time"))
    return observed(spark, path).select("profile_no", LEVEL, *(r6(v, k) for k, v in sets.items()))


_CONSTANT = {"t": "temperature_k", "q": "q", "p": f"{LEVEL} / {d(1000.0)}", "hour_cos": f"cos(hour(time) * {_TURN} / 24)"}


@query("PF22", f"""WITH {OBS}, x AS (SELECT *, {", ".join(f"{v} AS x_{k}" for k, v in _CONSTANT.items())} FROM obs WHERE valid),
t AS (SELECT {LEVEL}, {", ".join(f"CASE WHEN stddev_pop(x_{k}) <= {d(1e-12)} * greatest(1, abs(avg(x_{k}))) THEN avg(x_{k}) END AS f_{k}" for k in _CONSTANT)} FROM x WHERE time < TIMESTAMP '{DEV}' AND hour(time) = 0 GROUP BY 1)
SELECT x.{LEVEL}, CAST(hour(time) AS INT) AS hour, {" AND ".join(f"coalesce(abs(x_{k} - f_{k}) <= {d(1e-9)}, true)" for k in _CONSTANT)} AS supported, count(*) AS n FROM x JOIN t ON t.{LEVEL} = x.{LEVEL} WHERE time >= TIMESTAMP '{DEV}' GROUP BY ALL""")
def feature_support(spark, path):
    """A model fitted on reports of 00 UTC has never seen another hour: rows whose value of a feature that was constant in training is another one aren't supported."""
    x = {"x_t": F.col("temperature_k"), "x_q": F.col("q"), "x_p": F.col(LEVEL) / 1000.0, "x_hour_cos": F.cos(F.hour("time") * (2 * math.pi / 24))}
    rows = observed(spark, path).where("valid").withColumns(x)
    old, new = rows.where((F.col("time") < _at(DEV)) & (F.hour("time") == 0)), rows.where(F.col("time") >= _at(DEV))
    return linear.support(new, old, list(x), LEVEL).groupBy(LEVEL, F.hour("time").alias("hour"), "supported").agg(F.count("*").alias("n"))


# Boosted corrections

LAYERS = boosting.Plan(rounds=8, rate=0.2, depth=3, bins=16, least=20, l2=0.01, rest=8)
CLIP = (0.005, 0.995)


def with_features(spark, path) -> tuple[DataFrame, list[str]]:
    """Rows that can be scored, with the mapping features; written once, since models read them again and again."""
    x = feature_sets.mapping()
    rows = predicted(spark, path).select("profile_no", "station_no", "time", LEVEL, "residual_dry", "residual_wet", "residual_total", "correction", "error", "sd", *(v.alias(k) for k, v in x.items()))
    return staged(rows, "features"), list(x)


def clipped(rows: DataFrame, guess: Column, training: DataFrame) -> DataFrame:
    """rows with raw (the guess) and guess, which is kept within quantiles of what each level showed in training; bounds are a row a level."""
    q = quantiles(training, F.col("residual_total"), [LEVEL], list(CLIP)).groupBy(F.col(LEVEL).alias("__level")).agg(*(F.max(F.when(F.col("k") == k, F.col("q"))).alias(c) for k, c in enumerate(("__low", "__high"))))
    both = rows.join(F.broadcast(q), rows[LEVEL] == q["__level"], "left").withColumn("raw", guess)
    inside = F.least(F.col("__high"), F.greatest(F.col("__low"), F.col("raw")))  # which pass over nulls: a level without bounds keeps its guess
    return both.withColumn("guess", F.when(F.col("raw").isNotNull(), inside)).drop("__level", "__low", "__high")


@unmatched("ML4")
def layer_models(spark, path):
    """Boosted trees for each level and each component, all grown at once; their sum stays within the level's bounds. Errors on later rows."""
    rows, x = with_features(spark, path)
    old, new = rows.where(F.col("time") < _at(DEV)), rows.where(F.col("time") >= _at(DEV))
    model = boosting.fit(old, x, ["residual_dry", "residual_wet"], LEVEL, LAYERS)
    scored = clipped(model.transform(new), F.col("boosted_residual_dry") + F.col("boosted_residual_wet"), old)
    e = F.col("guess") - F.col("residual_total")
    return scored.groupBy(LEVEL).agg(F.count("*").alias("n"), r6(rmse(e), "rmse"), r6(rmse(F.col("residual_total")), "rmse_raw"), F.count_if(F.col("guess") != F.col("raw")).alias("n_clipped"))


BUDGETS = (3, 6, 12)


def budget_scores(train: DataFrame, early: DataFrame, x: list[str], by: str | None, plan: boosting.Plan, budgets: tuple[int, ...]) -> DataFrame:
    """objective, iterations, stations, score (mean over stations of the early rows' RMSE), chosen: the least score, the smaller budget among equal ones.

    One fit of the largest budget: boosting's first k rounds are the model of budget k, so all budgets are scored in one pass.
    """
    model = boosting.fit(train, x, ["residual_dry", "residual_wet", "residual_total"], by, plan)
    scored = model.transform(early, "b_", budgets)
    both = lambda k: F.col(f"b_residual_dry_{k}") + F.col(f"b_residual_wet_{k}")
    guesses = [(o, k, g(k)) for o, g in (("components", both), ("total", lambda k: F.col(f"b_residual_total_{k}"))) for k in budgets]
    wide = scored.groupBy("station_no").agg(*(rmse(g - F.col("residual_total")).alias(f"{o}{k}") for o, k, g in guesses))
    s = wide.agg(F.array(*(F.struct(F.lit(o).alias("objective"), F.lit(k).alias("iterations"), F.count("*").alias("stations"), F.avg(f"{o}{k}").alias("score")) for o, k, _ in guesses)).alias("s")).select(F.inline("s"))
    by_objective = Window.partitionBy("objective").orderBy("score", "iterations")
    return s.withColumn("chosen", F.row_number().over(by_objective) == 1)  # a row a budget


@unmatched("ML13")
def iteration_budget(spark, path):
    """Budgets of boosting, with and without the hour, by components and for the total, on stations that training hasn't seen."""
    rows, x = with_features(spark, path)
    early = F.pmod(F.crc32(F.col("station_no").cast("string").cast("binary")), F.lit(4)) == 0
    old = rows.where(F.col("time") < _at(DEV))
    plan = boosting.Plan(rounds=max(BUDGETS), rate=0.2, depth=2, bins=16, least=30, l2=0.1, rest=6)
    parts = [budget_scores(old.where(~early), old.where(early), [c for c in x if hours or not c.startswith("hour")], None, plan, BUDGETS).withColumn("hours", F.lit(hours)) for hours in (True, False)]
    return parts[0].unionByName(parts[1]).withColumn("score", F.round("score", 6))


# Scales

_Q90 = "greatest(quantile_cont(abs(error) / s, 0.9) / {}, CAST(1e-6 AS DOUBLE))".format(d(Z90))


@query("ML6", f"""WITH {PRED}, g AS (SELECT greatest(sqrt(avg(error * error)), {d(spread.FLOOR)}) AS s FROM pred WHERE time < TIMESTAMP '{DEV}'),
l AS (SELECT {LEVEL}, greatest(sqrt(avg(error * error)), {d(spread.FLOOR)}) AS s FROM pred WHERE time < TIMESTAMP '{DEV}' GROUP BY 1),
r AS (SELECT 'global' AS variant, p.{LEVEL}, time, error, g.s FROM pred p, g UNION ALL SELECT 'level', p.{LEVEL}, time, error, coalesce(l.s, g.s) FROM pred p LEFT JOIN l ON l.{LEVEL} = p.{LEVEL}, g),
c AS (SELECT variant, {LEVEL}, {_Q90} AS factor FROM r WHERE time >= TIMESTAMP '{DEV}' AND time < TIMESTAMP '{CAL}' GROUP BY ALL), a AS (SELECT variant, {_Q90} AS pooled FROM r WHERE time >= TIMESTAMP '{DEV}' AND time < TIMESTAMP '{CAL}' GROUP BY 1)
SELECT r.variant, r.{LEVEL}, count(*) AS n, round(any_value(s), 6) AS raw_sd, round(any_value(coalesce(factor, pooled)), 6) AS factor, count(*) FILTER (abs(error) <= s * coalesce(factor, pooled) * {d(Z90)} * {d(spread.ON_BOUND)}) AS n_inside
FROM r LEFT JOIN c ON c.variant = r.variant AND c.{LEVEL} = r.{LEVEL} JOIN a ON a.variant = r.variant WHERE time >= TIMESTAMP '{CAL}' GROUP BY ALL""")
def calibrated_spread(spark, path):
    """One scale for all rows and one a level, calibrated by level on the months after training so that 90 % lie inside; counts are of still later rows, those on the bound included."""
    rows = staged(predicted(spark, path).select(LEVEL, "time", "error"), "errors")
    old = rows.where(F.col("time") < _at(DEV))
    least = lambda c: F.greatest(rmse(c), F.lit(spread.FLOOR))
    whole = old.agg(least(F.col("error")).alias("global"))
    level = old.groupBy(F.col(LEVEL).alias("__l")).agg(least(F.col("error")).alias("__s"))  # six rows
    wide = rows.join(F.broadcast(whole)).join(F.broadcast(level), F.col(LEVEL) == F.col("__l"), "left").withColumn("level", F.coalesce("__s", "global"))
    out = [_inside(wide, v, F.col("error"), F.col(v)) for v in ("global", "level")]
    return out[0].unionByName(out[1])


def _inside(rows: DataFrame, variant: str, error: Column, scale: Column) -> DataFrame:
    """variant, level, n, raw_sd, factor, n_inside: calibrated between DEV and CAL, counted after it."""
    t = F.col("time")
    some = rows.select(LEVEL, "time", error.alias("e"), scale.alias("s"))
    factors = spread.calibrated(some.where((t >= _at(DEV)) & (t < _at(CAL))), F.col("e"), F.col("s"), LEVEL, 0.9, Z90)
    late = spread.with_factor(some.where(t >= _at(CAL)), factors, LEVEL, "factor")
    inside = F.abs("e") <= F.col("s") * F.col("factor") * Z90 * spread.ON_BOUND
    return late.groupBy(LEVEL).agg(F.lit(variant).alias("variant"), F.count("*").alias("n"), r6(F.avg("s"), "raw_sd"), r6(F.max("factor"), "factor"), F.count_if(inside).alias("n_inside"))


SPREAD = boosting.Plan(rounds=6, rate=0.25, depth=2, bins=16, least=30, l2=0.1, rest=6)


def probabilistic(rows: DataFrame, training: DataFrame, x: list[str], components: list[str], plan: boosting.Plan = SPREAD) -> DataFrame:
    """rows with mean_, log_ + component: boosted means, and boosted logs of the size of cross-fitted errors of training rows."""
    fold = F.pmod(F.crc32(F.col("station_no").cast("string").cast("binary")), F.lit(spread.FOLDS))
    marked = training.withColumn("fold", fold.cast("int"))
    alone, copied = boosting.edges_of(marked, x, components, plan.bins, (1, spread.FOLDS - 1))
    by_fold = spread.folds_table(marked, x, components, "fold", plan, edges=copied)
    errors = {f"log_{c}": spread.log_error(F.col(c) - F.col(f"oof_{c}")) for c in components}
    oof = staged(spread.crossfitted(marked.select("fold", *components, *x), x, components, "fold", plan, of=by_fold).select(*x, *(v.alias(k) for k, v in errors.items())), "oof")
    sizes = boosting.grown(boosting.table(oof, x, list(errors), None, plan.bins, edges=alone), plan)  # the same rows, so the same edges
    same = all(np.array_equal(a, b) for a, b in zip(alone, copied, strict=True))  # as where values repeat
    means = boosting.grown(by_fold if same else boosting.table(training, x, components, None, plan.bins, edges=alone), plan, [0], [[0]] * (len(by_fold.groups) if same else 1))
    means.by = None
    return sizes.transform(means.transform(rows, "mean_"), "")


@unmatched("ML6_heteroscedastic")
def heteroscedastic_spread(spark, path):
    """Scales that depend on the features: boosted for the total and for both components, log-linear for the total; calibrated and counted as ML6 does."""
    rows, x = with_features(spark, path)
    old = rows.where(F.col("time") < _at(DEV))
    late = rows.where(F.col("time") >= _at(DEV))
    components = ["residual_total", "residual_dry", "residual_wet"]
    scored = staged(probabilistic(late, old, x, components), "scored")
    out = [_inside(scored, f"boosted_{c.removeprefix('residual_')}", F.col(f"mean_{c}") - F.col(c), spread.bounded(F.col(f"log_{c}"))) for c in components]
    model, _ = spread.loglinear(old, x, "error")
    out.append(_inside(model.transform(late, ""), "loglinear_total", F.col("error"), spread.bounded(F.col("log_scale"))))
    both = out[0]
    for more in out[1:]:
        both = both.unionByName(more)
    return both


# Series

LAGS, HORIZONS = 8, (1, 3)
LAG_TREES = boosting.Plan(rounds=6, rate=0.25, depth=2, bins=16, least=20, l2=0.01, rest=6)


def lag_table(spark, path) -> tuple[DataFrame, list[str], list[str]]:
    """A row for each window of LAGS reports of a station: its values, the station's place, the calendar; the value at each horizon; old: from the first 70 % of the station's reports."""
    s = sequences.split(src.series(spark, path), "station", ["ts", "event_id"], 0.7, 0.0)
    by = Window.partitionBy("station").orderBy("ts", "event_id")
    ahead = {f"y{h}": F.lead("value", h).over(by) for h in HORIZONS}
    rows = s.withColumns({"x": F.collect_list("value").over(by.rowsBetween(-(LAGS - 1), 0)), **ahead}).where(F.size("x") == LAGS)
    place = feature_sets.coordinates(F.lit(-85) + (F.col("station") * 37) % 170, (F.col("station") * 53) % 360 + 0.5)
    x = feature_sets.window("x", LAGS) | place | feature_sets.calendar(F.col("ts"))
    return staged(rows.select("event_id", "station", (F.col("part") == "train").alias("old"), *ahead, *(v.alias(k) for k, v in x.items())), "lags"), list(x), list(ahead)


@unmatched("ML9")
def lag_regressors(spark, path):
    """Ridge and boosted trees from the whole window to each horizon, fitted on the first part of each station's reports, compared on the rest."""
    rows, x, ys = lag_table(spark, path)
    old, new = rows.where("old").na.drop(subset=ys), rows.where("NOT old")
    scored = linear.fit(old, x, ys, penalty=1.0).transform(new, "lag_ridge_")
    scored = boosting.fit(old, x, ys, None, LAG_TREES).transform(scored, "lag_boosted_")
    each = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(h).alias("horizon"), (F.col(f"{m}_y{h}") - F.col(f"y{h}")).alias("e")) for m in ("lag_ridge", "lag_boosted") for h in HORIZONS))
    return scored.select(F.inline(each)).where("e IS NOT NULL").groupBy("model", "horizon").agg(F.count("*").alias("n_test"), r6(rmse(F.col("e")), "rmse"))


# A suite of models


def agreed(rows: DataFrame, a: Column, b: Column, tolerance: float = 1e-9) -> DataFrame:
    """rows; reading any in which a and b differ by more than tolerance, or one alone is null, raises. The check runs in the pass that reads a row, no earlier and no extra one."""
    ok = F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())
    shown = (F.coalesce(c.cast("string"), F.lit("null")) for c in (a, b))
    return checks.required(rows, ok, F.concat(F.lit("boosted means differ: "), F.concat_ws(" and ", *shown)))


@unmatched("ML15")
def model_suite(spark, path):
    """Climatology, ridge and boosted models side by side on rows after CAL, with a spread of the probabilistic model, whose mean has to be the boosted model's; support, level and season are the groups."""
    rows, x = with_features(spark, path)
    old = rows.where(F.col("time") < _at(DEV))
    components = ["residual_dry", "residual_wet", "residual_total"]
    scored = probabilistic(rows.where(F.col("time") >= _at(DEV)), old, x, components)
    scored = boosting.fit(old, x, ["residual_total"], None, SPREAD).transform(scored)
    scored = agreed(linear.fit(old, x, components[:2], LEVEL, 1.0, scaled=True).transform(scored), F.col("boosted_residual_total"), F.col("mean_residual_total"))
    scored = staged(linear.support(scored, old, x, LEVEL), "suite")
    t = F.col("time")
    scale = spread.bounded(F.col("log_residual_total"))
    factors = spread.calibrated(scored.where((t >= _at(DEV)) & (t < _at(CAL))), F.col("mean_residual_total") - F.col("residual_total"), scale, LEVEL, 0.9, Z90)
    late = spread.with_factor(scored.where(t >= _at(CAL)), factors, LEVEL, "factor")
    models = {"none": F.lit(0.0), "climatology": F.col("correction"), "ridge": F.col("linear_residual_dry") + F.col("linear_residual_wet"), "boosted": F.col("boosted_residual_total"), "boosted_components": F.col("mean_residual_dry") + F.col("mean_residual_wet")}
    each = F.array(*(F.struct(F.lit(k).alias("model"), (v - F.col("residual_total")).alias("e")) for k, v in models.items()))
    season = F.floor(F.month("time") % 12 / 3).cast("int")
    long = late.select(LEVEL, "supported", season.alias("season"), (scale * F.col("factor")).alias("sd"), F.inline(each))
    return long.groupBy("model", LEVEL, "season", "supported").agg(F.count("*").alias("n"), r6(F.avg("e"), "bias"), r6(rmse(F.col("e")), "rmse"), r6(F.count_if(F.abs("e") <= Z90 * F.col("sd")) / F.count("*"), "coverage"))
