"""Linear, scale and boosted models and their queries against numpy on tables that fit into memory."""

import math

import duckdb
import numpy as np
import pytest
from compare import of_duck, of_spark
from pyspark.sql import functions as F
from test_boosting import plain

from aerolith.models import boosting, linear, spread
from aerolith.plans import models

PLAN = boosting.Plan(rounds=3, rate=0.3, depth=2, bins=8, least=10)


def columns(df, *names):
    rows = df.select(*names).collect()
    return [np.array([np.nan if r[c] is None else r[c] for r in rows], float) for c in names]


def ridge(x, y, penalty, scaled):
    keep = x.std(0) > 1e-12 * np.maximum(1, abs(x.mean(0)))
    scale = x.std(0) if scaled else np.ones(x.shape[1])
    z = (x - x.mean(0))[:, keep] / scale[keep]
    w, *_ = np.linalg.lstsq(np.vstack([z, math.sqrt(penalty) * np.eye(keep.sum())]), np.r_[y - y.mean(), np.zeros(keep.sum())], rcond=None)
    return lambda rows: y.mean() + ((rows - x.mean(0))[:, keep] / scale[keep]) @ w


@pytest.mark.parametrize("by,scaled", [(None, False), ("g", True)])
def test_ridge_against_least_squares(spark, by, scaled):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6)) * [1, 100, 1e-3, 1, 1, 1] + [0, 1e4, 0, 5, 0, 0]
    g = rng.integers(0, 3, 400)
    x[:, 4], x[g == 1, 5] = 7.0, 2.5  # constant everywhere, and in one group
    y = np.stack([x[:, 0] * 2 + x[:, 1] / 50 + g + rng.normal(size=400), x[:, 3] ** 2], 1)
    names = [f"x{k}" for k in range(6)]
    df = spark.createDataFrame([(int(a), *map(float, r), *map(float, t)) for a, r, t in zip(g, x, y, strict=True)] + [(0, None, *[1.0] * 7)], f"g long, {', '.join(f'{n} double' for n in names)}, y0 double, y1 double").repartition(5)
    model = linear.fit(df, names, ["y0", "y1"], by, 1.5, scaled)
    rows = model.transform(df).where("x0 IS NOT NULL")
    found = columns(rows, "g", *names, "linear_y0", "linear_y1")
    assert len(found[0]) == 400
    for a in range(3) if by else [None]:
        use, own = (g == a, found[0] == a) if by else (g >= 0, found[0] >= 0)
        for t in range(2):
            want = ridge(x[use], y[use, t], 1.5, scaled)(np.stack(found[1:7], 1)[own])
            assert np.allclose(found[7 + t][own], want, rtol=1e-8)
    assert model.kept.tolist() == [[True, True, True, True, False, not (by and j == 1)] for j in range(3 if by else 1)]


def test_loglinear_scale_is_the_likelihoods_maximum(spark):
    rng = np.random.default_rng(2)
    x = np.stack([rng.normal(size=4000), rng.uniform(0, 100, 4000), np.full(4000, 3.0)], 1)
    e = rng.normal(size=4000) * np.exp(0.5 + 0.4 * x[:, 0] - 0.01 * x[:, 1])
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, e, strict=True)], "a double, b double, c double, e double")
    model, rounds = spread.loglinear(df, ["a", "b", "c"], "e")
    w, b = model.coefficients[0, 0], model.intercepts[0, 0]
    assert rounds < 25 and w[2] == 0 and np.allclose([w[0], w[1]], [0.4, -0.01], atol=0.03) and abs(b - 0.5) < 0.1
    slope = (e**2 * np.exp(-2 * (b + x @ w)) - 1) @ np.c_[np.ones(4000), x[:, 0], x[:, 1] / 50] / 4000
    assert np.abs(slope).max() < 1e-6  # what the likelihood's gradient is zero for


def test_crossfitted_rows_come_from_other_folds(spark):
    rng = np.random.default_rng(1)
    x, fold = rng.normal(size=(600, 2)), rng.integers(0, 5, 600)
    y = np.sin(x[:, 0] * 3) + fold + 0.1 * rng.normal(size=600)
    df = spark.createDataFrame([(float(a), float(b), int(f), float(t), i) for i, ((a, b), f, t) in enumerate(zip(x, fold, y, strict=True))], "a double, b double, fold int, y double, i long")
    found = spread.crossfitted(df, ["a", "b"], ["y"], "fold", PLAN).orderBy("i").collect()
    others = df.withColumn("held", F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda k: k != F.col("fold"))))
    edges = boosting.edges(others, ["a", "b"], PLAN.bins)
    for f in range(5):
        want = plain(x[fold != f], y[fold != f], edges, PLAN)[1](x[fold == f])
        assert np.allclose([found[i].oof_y for i in np.flatnonzero(fold == f)], want, atol=1e-6)


def test_factors_of_levels_and_pooled(spark):
    rng = np.random.default_rng(4)
    e, s, level = rng.normal(size=500), rng.uniform(0.5, 2, 500), rng.choice([1, 2], 500)
    df = spark.createDataFrame([(int(v), float(a), float(b)) for v, a, b in zip(level, e, s, strict=True)], "level int, e double, s double")
    factors = spread.calibrated(df, F.col("e"), F.col("s"), "level", 0.9, models.Z90)
    got = {r.level: r.f for r in spread.with_factor(spark.createDataFrame([(1,), (2,), (3,)], "level int"), factors, "level", "f").collect()}
    for v, of in ((1, level == 1), (2, level == 2), (3, level > 0)):
        assert got[v] == pytest.approx(np.quantile(abs(e[of]) / s[of], 0.9) / models.Z90)
    assert {r.f for r in spread.with_factor(df, factors.limit(0), "level", "f").collect()} == {1.0}


def test_support_of_constant_features(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (1, 5.0, 2.0), (2, 4.0, 3.0), (2, 6.0, 3.0)], "g int, a double, b double")
    new = spark.createDataFrame([(1, 5.0, 9.0), (1, 5.1, 1.0), (2, 5.1, 3.0), (2, 5.1, 3.1), (2, 1.0, None), (3, 5.0, 3.0)], "g int, a double, b double")
    assert [r.supported for r in linear.support(new, df, ["a", "b"], "g").collect()] == [True, False, True, False, False, False]


@pytest.fixture(scope="module")
def rows(spark, sf):
    return models.with_features(spark, sf)


def test_layer_models(spark, sf, rows):
    """ML4: trees of each level and component, their sum within the level's quantiles, errors on later rows."""
    df, x = rows
    old, new = (df.where(f"time {op} TIMESTAMP '{models.DEV}'") for op in ("<", ">="))
    edges = boosting.edges(old, x, models.LAYERS.bins)
    names = ["pressure_hpa", "residual_dry", "residual_wet", "residual_total", *x]
    (level, *ys), (level2, *ys2) = columns(old, *names), columns(new, *names)
    got = {r.pressure_hpa: r for r in models.Q["ML4"](spark, sf).collect()}
    for p in (1000, 700, 300):
        a, b = level == p, level2 == p
        guess = sum(plain(np.stack(ys[3:], 1)[a], ys[k][a], edges, models.LAYERS)[1](np.stack(ys2[3:], 1)[b]) for k in range(2))
        low, high = np.quantile(ys[2][a], models.CLIP)
        r = got[p]
        assert r.n == b.sum() and r.n_clipped == ((guess < low) | (guess > high)).sum()
        assert r.rmse == pytest.approx(math.sqrt(np.mean((np.clip(guess, low, high) - ys2[2][b]) ** 2)), abs=2e-6)


def test_iteration_budgets(spark, sf, rows):
    """ML13: every budget's mean station error, and the least of them chosen."""
    import zlib

    df, x = rows
    names = ["station_no", "residual_dry", "residual_wet", "residual_total", *x]
    old = df.where(f"time < TIMESTAMP '{models.DEV}'")
    station, *cols = columns(old, *names)
    early = np.array([zlib.crc32(str(int(s)).encode()) % 4 == 0 for s in station])
    plan = boosting.Plan(rounds=max(models.BUDGETS), rate=0.2, depth=2, bins=16, least=30, l2=0.1)
    train = old.where(F.pmod(F.crc32(F.col("station_no").cast("string").cast("binary")), F.lit(4)) != 0)
    edges = boosting.edges(train, x, 16)
    xs, got = np.stack(cols[3:], 1), models.Q["ML13"](spark, sf).collect()
    assert len(got) == 4 * len(models.BUDGETS) and sum(r.chosen for r in got) == 4
    for k in models.BUDGETS[:2]:
        some = boosting.Plan(**{**plan.__dict__, "rounds": k})
        guess = [plain(xs[~early], y[~early], edges, some)[1](xs[early]) for y in cols[:3]]
        for objective, g in (("components", guess[0] + guess[1]), ("total", guess[2])):
            e = (g - cols[2][early]) ** 2
            want = np.mean([math.sqrt(e[station[early] == s].mean()) for s in np.unique(station[early])])
            (r,) = [r for r in got if (r.objective, r.iterations, r.hours) == (objective, k, True)]
            assert r.score == pytest.approx(want, abs=2e-6) and r.stations == len(np.unique(station[early]))
    for hours in (True, False):
        for objective in ("components", "total"):
            some = [r for r in got if (r.objective, r.hours) == (objective, hours)]
            assert [r.iterations for r in some if r.chosen] == [min((r.score, r.iterations) for r in some)[1]]


def test_lag_regressors(spark, sf):
    """ML9: ridge and trees on the whole window."""
    df, x, ys = models.lag_table(spark, sf)
    got = {(r.model, r.horizon): r for r in models.Q["ML9"](spark, sf).collect()}
    old = df.where("old").na.drop(subset=ys)
    edges = boosting.edges(old, x, models.LAG_TREES.bins)
    a = columns(old, *ys, *x)
    for k, h in enumerate(models.HORIZONS):
        b = columns(df.where(f"NOT old AND y{h} IS NOT NULL"), f"y{h}", *x)
        xs, new = np.stack(a[len(ys) :], 1), np.stack(b[1:], 1)
        for model, guess in (("lag_ridge", ridge(xs, a[k], 1.0, False)), ("lag_boosted", plain(xs, a[k], edges, models.LAG_TREES)[1])):
            r = got[model, h]
            assert r.n_test == len(new) and r.rmse == pytest.approx(math.sqrt(np.mean((guess(new) - b[0]) ** 2)), rel=1e-6)


def test_heteroscedastic_spread_covers_what_it_was_calibrated_for(spark, sf):
    got = models.Q["ML6_heteroscedastic"](spark, sf).collect()
    assert {r.variant for r in got} == {"boosted_total", "boosted_dry", "boosted_wet", "loglinear_total"} and len(got) == 24
    for v in {r.variant for r in got}:
        some = [r for r in got if r.variant == v]
        assert 0.8 < sum(r.n_inside for r in some) / sum(r.n for r in some) < 0.97
        assert all(math.exp(spread.LOW) <= r.raw_sd <= math.exp(spread.HIGH) and r.factor > 0 for r in some)


def test_model_suite(spark, sf, rows):
    """ML15: each model on the same rows; the one without a correction has the raw errors."""
    got = models.Q["ML15"](spark, sf).collect()
    cells = {}
    for r in got:
        cells.setdefault((r.pressure_hpa, r.season, r.supported), {})[r.model] = r
    assert all(len(c) == 5 and len({r.n for r in c.values()}) == 1 for c in cells.values())
    total = rows[0].where(f"time >= TIMESTAMP '{models.CAL}'").agg(F.count("*").alias("n"), F.sum(F.col("residual_total") * F.col("residual_total")).alias("s")).first()
    none = [r for r in got if r.model == "none"]
    assert sum(r.n for r in none) == total.n and sum(r.n * r.rmse**2 for r in none) == pytest.approx(total.s, rel=1e-5)


def test_means_that_differ_raise(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, None), (2.0, 2.0)], "a double, b double")
    assert models.agreed(df, F.col("a"), F.col("b")).count() == 3
    for a, b in ((1.0, 1.1), (None, 1.0), (1.0, None)):
        with pytest.raises(Exception, match="boosted means differ"):
            models.agreed(df.union(spark.createDataFrame([(a, b)], "a double, b double")), F.col("a"), F.col("b")).count()


def test_rows_on_the_bound_are_inside(spark, tmp_path):
    """Profiles of one month of three years with the same levels: later errors are those that calibration has seen, so each lies on its bound. Query and SQL count all of them, whatever the order of sums."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    years = "SELECT k, CASE WHEN k < 400 THEN 1998 WHEN k < 430 THEN 1999 ELSE 2000 END AS y, k * 26 AS key FROM range(460) t(k)"
    con.execute(f"COPY (SELECT key AS o_orderkey, k AS o_custkey, make_timestamp(y, 3, 1, 0, 0, 0.0) AS o_orderdate FROM ({years})) TO '{tmp_path}/orders.parquet'")
    v = "CASE WHEN k < 400 THEN k % 7 ELSE 0 END"
    con.execute(f"""COPY (SELECT key AS l_orderkey, 1 AS l_partkey, 1 AS l_suppkey, CAST(n AS INT) AS l_linenumber, CAST(20 + n + {v} AS DOUBLE) AS l_quantity, 100.0::DOUBLE AS l_extendedprice, CAST(0.01 * n AS DOUBLE) AS l_discount,
      CAST(0.01 * ({v}) AS DOUBLE) AS l_tax, 'N' AS l_returnflag, 'F' AS l_linestatus FROM ({years}), range(1, 7) r(n)) TO '{tmp_path}/lineitem.parquet'""")
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = of_spark(models.Q["ML6"](spark, str(tmp_path)))
    assert got == of_duck(con, models.SQL["ML6"])
    at = {c: got[0].index(c) for c in ("n", "n_inside")}
    assert len(got[1]) == 10 and all(r[at["n"]] == r[at["n_inside"]] == "30" for r in got[1])
