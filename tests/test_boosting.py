"""Boosted trees against a plain version that keeps all rows in memory and looks at every split."""

import numpy as np
import pytest

from aerolith.models import boosting


def plain(x, y, edges, plan):
    """Predictions after each round, and for other rows by the same trees."""
    trees, base = [], y.mean()
    guess = np.full(len(y), base)

    def grow(rows, rest, depth):
        if depth == plan.depth:
            return plan.rate * rest[rows].sum() / (len(rows) + plan.l2) if len(rows) else 0.0
        best = (1e-12, None)
        score = lambda r: rest[r].sum() ** 2 / (len(r) + plan.l2)
        for k, e in enumerate(edges):
            for cut in [*e, np.inf]:
                with np.errstate(invalid="ignore"):
                    low = x[rows, k] <= cut
                a, b = rows[low], rows[~low]
                if min(len(a), len(b)) >= plan.least:
                    gain = score(a) + score(b) - score(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, (k, cut, a, b))
        if best[1] is None:
            value = plan.rate * rest[rows].sum() / (len(rows) + plan.l2)
            return value
        k, cut, a, b = best[1]
        return k, cut, grow(a, rest, depth + 1), grow(b, rest, depth + 1)

    def use(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    out = []
    for _ in range(plan.rounds):
        tree = grow(np.arange(len(y)), y - guess, 0)
        guess = guess + np.array([use(tree, r) for r in x])
        trees.append(tree)
        out.append(guess)
    return out, lambda rows: base + sum(np.array([use(t, r) for r in rows]) for t in trees)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 2000
    x = np.stack([rng.normal(size=n), rng.integers(0, 4, n).astype(float), rng.exponential(size=n)], 1)
    x[rng.random(n) < 0.05, 2] = np.nan
    level = rng.choice([1000, 850, 300], n)
    dry = np.sin(x[:, 0] * 2) + (x[:, 1] == 2) * level / 500 + 0.1 * rng.normal(size=n)
    wet = np.where(np.isnan(x[:, 2]), 3.0, x[:, 2]) * (level == 850) + 0.1 * rng.normal(size=n)
    rows = [(int(g), *map(lambda v: None if np.isnan(v) else float(v), r), float(a), float(b), i) for i, (g, r, a, b) in enumerate(zip(level, x, dry, wet, strict=True))]
    df = spark.createDataFrame(rows, "level int, a double, b double, c double, dry double, wet double, boosted long").repartition(7)
    return df, level, x, {"dry": dry, "wet": wet}


def test_boosting_against_plain_trees(table):
    df, level, x, targets = table
    plan = boosting.Plan(rounds=5, rate=0.3, depth=3, bins=8, least=15, l2=0.1, rest=2)
    model = boosting.fit(df, ["a", "b", "c"], ["dry", "wet"], "level", plan)
    found = model.transform(df, budgets=(1, 3, 5)).orderBy("boosted").collect()
    whole = model.transform(df).orderBy("boosted").collect()
    for g in (1000, 850, 300):
        rows = np.flatnonzero(level == g)
        for t, y in targets.items():
            want, again = plain(x[rows], y[rows], model.edges, plan)
            for b in (1, 3, 5):
                assert np.allclose([found[i][f"boosted_{t}_{b}"] for i in rows], want[b - 1], atol=1e-6)
            assert np.allclose([whole[i][f"boosted_{t}"] for i in rows], again(x[rows]), atol=1e-6)


def test_trees_do_not_depend_on_partitions(table):
    df = table[0]
    plan = boosting.Plan(rounds=2, depth=2, bins=8, rest=1)
    a, b = (boosting.fit(d, ["a", "b", "c"], ["dry"], "level", plan) for d in (df, df.repartition(3, "b")))
    assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.value == b.value).all() and (a.base == b.base).all()


def test_jobs_do_not_grow_with_groups(spark, table):
    def jobs(by):
        name = f"boosting-{by}"
        spark.sparkContext.setJobGroup(name, name)
        boosting.fit(table[0], ["a", "b"], ["dry", "wet"], by, boosting.Plan(rounds=2, depth=2, bins=8))
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        spark.sparkContext.setJobGroup("", "")
        return found

    assert abs(jobs("level") - jobs(None)) <= 1


def test_strange_groups_and_tables_raise(spark, table):
    df = table[0]
    plan = boosting.Plan(rounds=1, depth=1, bins=4)
    model = boosting.fit(df.where("level <> 300"), ["a"], ["dry"], "level", plan)
    with pytest.raises(Exception, match="no trees for level"):
        model.transform(df).collect()
    with pytest.raises(ValueError, match="no rows"):
        boosting.fit(df.limit(0), ["a"], ["dry"], "level", plan)
    with pytest.raises(ValueError, match="groups"):
        boosting.fit(df.withColumn("g", df.boosted % 300), ["a"], ["dry"], "g", plan)
    # a feature without values, and targets that don't vary, make no splits
    flat = boosting.fit(df.selectExpr("level", "CAST(null AS double) AS a", "1.5D AS dry"), ["a"], ["dry"], "level", plan)
    assert (flat.feature == -1).all() and {r.boosted_dry for r in flat.transform(df.select("level", "a")).collect()} == {1.5}


def test_rows_that_trees_cannot_tell_apart_are_one(spark, table, monkeypatch):
    """Five copies of a table are as many training rows as one."""
    df, *_ = table
    many = df.union(df).union(df).union(df).union(df)
    sizes, staged = [], boosting.staged
    monkeypatch.setattr(boosting, "staged", lambda rows, name: (sizes.append((out := staged(rows, name)).count()), out)[1])
    boosting.fit(many, ["a", "b", "c"], ["dry"], "level", boosting.Plan(rounds=1, depth=1, bins=8))
    assert 0 < sizes[0] <= df.count() < many.count()


@pytest.mark.parametrize("copies", [1, 4])
def test_edges_are_exact_quantiles(spark, copies):
    """Values of all sizes and both signs, few different ones, none, one; each row once or four times."""
    rng = np.random.default_rng(11)
    n = 3000
    x = [rng.normal(size=n) * 10.0 ** rng.integers(-8, 8, n), np.round(rng.normal(size=n), 1), np.where(rng.random(n) < 0.3, np.nan, rng.exponential(size=n) - 1), np.full(n, -0.0), np.full(n, np.nan), 1e9 + rng.random(n) * 1e-3]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in np.stack(x, 1)], ", ".join(f"x{k} double" for k in range(len(x)))).repartition(5)
    found = boosting.edges(df, df.columns, 16, copies)
    for have, v in zip(found, x, strict=True):
        v = np.repeat(v[~np.isnan(v)], copies)
        want = np.unique(np.quantile(v, np.arange(1, 16) / 16)) if len(v) else np.zeros(0)
        assert len(have) == len(want) and np.allclose(have, want, rtol=1e-12, atol=0)
        for e, w in zip(have, want, strict=True):
            assert (v <= e).sum() == (v <= w).sum() or abs(e - w) <= 1e-12 * abs(w)
    assert boosting.edges_of(df.withColumn("t", df.x1 * 0), df.columns, ["t"], 16, (copies, 2))[0][1].tolist() == found[1].tolist()


def test_crossfit_does_not_copy_rows(spark):
    """What is shuffled and written for the trees of all folds is a row a training row at most, not one for each fold that it isn't in, nor one a feature."""
    from pyspark.sql import functions as F

    from aerolith.models import spread

    df = spark.range(8000).select((F.col("id") % 5).cast("int").alias("fold"), (F.col("id") * 7919 % 97 / 10).alias("a"), (F.col("id") * 104729 % 89 / 7).alias("b"), (F.col("id") * 31 % 83).cast("double").alias("c"), F.sin("id").alias("y"))
    context, store = spark.sparkContext._jsc.sc(), spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def moved():
        context.listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() + s.outputRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    before = moved()
    found = spread.crossfitted(df, ["a", "b", "c"], ["y"], "fold", boosting.Plan(rounds=2, depth=2, bins=16))
    assert sum(n for k, n in moved().items() if k not in before) < 1.5 * df.count()
    assert found.where("oof_y IS NOT NULL").count() == df.count()
