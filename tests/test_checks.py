"""Joins, phases, comparisons and ledgers whose contract is broken on purpose."""

import os

import pytest
from pyspark.sql import functions as F

from aerolith.operators import checks, ledger


def table(spark, rows, names="k long, v string"):
    return spark.createDataFrame(rows, names)


def test_checked_join_fails_where_its_contract_does(spark):
    left = table(spark, [(1, "a"), (2, "b"), (None, "c")])
    right = table(spark, [(1, "x"), (2, "y"), (None, "z"), (9, "w")], "k long, w string")
    want = [(None, "c", "z"), (1, "a", "x"), (2, "b", "y")]
    for cardinality in ("one_to_one", "many_to_one"):
        assert sorted(map(tuple, checks.checked_join(left, right, ["k"], cardinality).collect()), key=str) == sorted(want, key=str)
    twice = left.union(table(spark, [(2, "b2")]))
    assert checks.checked_join(twice, right, ["k"], "many_to_one").count() == 4
    with pytest.raises(Exception, match="left side has a key more than once: k=2"):
        checks.checked_join(twice, right, ["k"], "one_to_one").count()
    for cardinality in ("one_to_one", "many_to_one"):
        with pytest.raises(Exception, match="right side has a key more than once: k=null"):
            checks.checked_join(left, right.union(table(spark, [(None, "q")])), ["k"], cardinality).count()
    strange = left.union(table(spark, [(5, "e")]))
    with pytest.raises(Exception, match="no match on the right side: k=5"):
        checks.checked_join(strange, right, ["k"], "one_to_one").count()
    assert checks.checked_join(strange, right, ["k"], "one_to_one", every=False).where("w IS NULL").count() == 1
    with pytest.raises(ValueError, match="both sides have"):
        checks.checked_join(left, left, ["k"], "one_to_one")
    with pytest.raises(ValueError, match="cardinality"):
        checks.checked_join(left, right, ["k"], "many_to_many")


def test_phases_that_share_keys(spark):
    a, b, c = (table(spark, rows) for rows in ([(1, "s"), (1, "s"), (2, "s")], [(2, "s"), (3, "s"), (None, "s")], [(None, "s"), (4, "s")]))
    found = checks.overlaps({"c": c, "a": a, "b": b}, ["k", "v"]).collect()
    assert sorted(map(tuple, found)) == [("a", "b", 1), ("b", "c", 1)]
    with pytest.raises(ValueError, match="a and b 1, b and c 1"):
        checks.disjoint({"a": a, "b": b, "c": c}, ["k", "v"])
    checks.disjoint({"a": a, "c": c}, ["k", "v"])


def test_comparison_sees_each_kind_of_difference(spark):
    new = [(k, True, float(k), 1.0) for k in range(6)]
    schema = "k long, mask boolean, x double, y double"

    def row(old, column="x"):
        (r,) = checks.compared(table(spark, new, schema), table(spark, old, schema), ["k"], "mask", ["x", "y"], 1e-3).where(F.col("column") == column).collect()
        return r

    same = row([(k, True, k + 5e-4, 1.0) for k in range(6)])
    assert same.same and same.n_common == 6 and same.max_abs == pytest.approx(5e-4)
    for old, field, value in (
        ([*new[:5], (5, True, 5.1, 1.0)], "max_abs", pytest.approx(0.1)),
        ([*new[:5], (5, None, 5.0, 1.0)], "mask_disagreements", 1),
        (new[:5], "only_new", 1),
        ([*new, (9, True, 1.0, 1.0)], "only_old", 1),
        ([*new[:5], (5, True, None, 1.0)], "n_common", 6),
    ):
        r = row(old)
        assert r[field] == value and not r.same
    assert row([*new[:5], (5, True, 5.1, 1.0)], "y").same
    with pytest.raises(Exception, match="old side has a key more than once: k=0"):
        row([*new, new[0]])


def test_ledger_makes_again_what_changed_and_nothing_else(spark, tmp_path):
    folder, made = str(tmp_path / "out"), []
    rows = [(m, k, float(k)) for m in ("2024-01", "2024-02", "2024-03") for k in range(20)] + [(None, 1, 1.0)]

    def run(rows, config={"v": 1}, fail=False):  # noqa: B006
        def job(df):
            made.append(sorted(r.month for r in df.select("month").distinct().collect()))
            return df.groupBy("month").agg(F.sum("x").alias("x"), F.count("*").alias("n"))

        df = spark.createDataFrame(rows, "month string, k long, x double")
        return ledger.run(df, "month", job if not fail else (lambda df: job(df).withColumn("x", F.raise_error(F.lit("lost")).cast("double"))), config, folder)

    def results():
        return {r.month: (r.x, r.n) for r in ledger.results(spark, folder).collect()}

    def files():
        return {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder + "/data") for f in names if f.endswith(".parquet")}

    assert run(rows[:40]) == ["2024-01", "2024-02"] and results() == {"2024-01": (190.0, 20), "2024-02": (190.0, 20)}
    first = files()
    assert run(list(reversed(rows[:40]))) == [] and len(made) == 1  # the order of rows is no change
    changed = [(m, k, x + (m == "2024-02" and k == 7)) for m, k, x in rows]
    with pytest.raises(Exception, match="lost"):
        run(changed, fail=True)
    assert results() == {"2024-01": (190.0, 20), "2024-02": (190.0, 20)}  # what was there still holds
    assert run(changed) == ["2024-02", "2024-03"] and made[-1] == ["2024-02", "2024-03"]
    assert results() == {"2024-01": (190.0, 20), "2024-02": (191.0, 20), "2024-03": (190.0, 20)}
    assert {k: v for k, v in files().items() if "2024-01" in k[0]} == {k: v for k, v in first.items() if "2024-01" in k[0]}
    assert run(changed[20:]) == [] and set(results()) == {"2024-02", "2024-03"}  # a month without input is taken out
    assert run(changed) == ["2024-01"] and len(results()) == 3
    assert run(changed, {"v": 2}) == ["2024-01", "2024-02", "2024-03"]  # so is another configuration
    nulls = [(m, k, None if k == 3 else x) for m, k, x in changed]
    assert run(nulls, {"v": 2}) == ["2024-01", "2024-02", "2024-03"]
    assert [r.run for r in ledger.entries(spark, folder).select("run").distinct().orderBy("run").collect()] == list(range(1, ledger.entries(spark, folder).agg(F.max("run")).first()[0] + 1))


def test_fingerprint_tells_columns_nulls_and_repeats_apart(spark):
    def of(rows, names="m string, a long, b long"):
        return ledger.fingerprints(spark.createDataFrame(rows, names), "m", {}).first().fingerprint

    rows = [("x", 1, 2), ("x", 3, None)]
    assert of(rows) == of(rows[::-1])
    others = [[("x", 2, 1), ("x", 3, None)], [("x", 1, 2), ("x", None, 3)], [*rows, rows[0]], rows[:1], [("x", 1, 2), ("x", 3, 0)]]
    assert len({of(r) for r in [rows, *others]} | {of(rows, "m string, a long, c long")}) == 7
