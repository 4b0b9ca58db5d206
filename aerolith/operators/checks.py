"""Joins and comparisons that fail, inside the plan, where their contract doesn't hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def required(rows: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    """rows; reading one for which ok isn't true raises. Nothing is read twice for it."""
    text = F.lit(message) if isinstance(message, str) else message
    return rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def _shown(keys: list[str]) -> Column:
    return F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys))


def unique(rows: DataFrame, keys: list[str], side: str) -> DataFrame:
    """rows; a key that comes twice raises. Rows are dealt by the keys, as the join after it deals them, so that costs no shuffle of its own."""
    counted = rows.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    return required(counted, F.col("__n") == 1, F.concat(F.lit(f"{side} side has a key more than once: "), _shown(keys))).drop("__n")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], cardinality: str, every: bool = True) -> DataFrame:
    """left with right's other columns, by on (nulls are equal). cardinality: one_to_one or many_to_one.

    The right side's keys have to be unique, for one_to_one the left side's as well; every: a row of left without a
    match raises, else it keeps nulls. The join fails when it is read, with the key in its message.
    """
    if cardinality not in ("one_to_one", "many_to_one"):
        raise ValueError(f"unknown cardinality {cardinality}")
    clash = (set(left.columns) & set(right.columns)) - set(on)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    left = unique(left, on, "left") if cardinality == "one_to_one" else left
    right = unique(right, on, "right").withColumnsRenamed({k: f"__{k}" for k in on}).withColumn("__there", F.lit(True))
    same = reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[f"__{k}"]) for k in on))
    both = left.join(right, same, "left")
    if every:
        both = required(both, F.col("__there").isNotNull(), F.concat(F.lit("no match on the right side: "), _shown(on)))
    return both.drop("__there", *(f"__{k}" for k in on))


def overlaps(phases: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """left_phase, right_phase, shared: keys that two phases have in common; pairs that share none have no row. One shuffle of distinct keys."""
    tagged = [df.select(*keys, F.lit(name).alias("phase")).distinct() for name, df in sorted(phases.items())]
    of = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(F.sort_array(F.collect_list("phase")).alias("ps")).where(F.size("ps") > 1)
    pairs = F.flatten(F.transform("ps", lambda a, i: F.transform(F.filter("ps", lambda b: b > a), lambda b: F.struct(a.alias("left_phase"), b.alias("right_phase")))))
    return of.select(F.inline(pairs)).groupBy("left_phase", "right_phase").agg(F.count("*").alias("shared"))


def disjoint(phases: dict[str, DataFrame], keys: list[str]) -> None:
    """Raises if two phases share a key."""
    found = overlaps(phases, keys).collect()  # a row a pair of phases
    if found:
        raise ValueError("phases share keys: " + ", ".join(f"{r.left_phase} and {r.right_phase} {r.shared}" for r in sorted(found)))


def compared(new: DataFrame, old: DataFrame, keys: list[str], mask: str, columns: list[str], tolerance: float) -> DataFrame:
    """One row a column: n_common (rows that both masks keep), mask_disagreements, only_new, only_old (keys of one side), max_abs, same.

    same: no key is missing, masks agree, and no common row differs by more than tolerance or is null on one side alone.
    Keys have to be unique on both sides; a null mask is false.
    """
    side = lambda df, tag: unique(df.select(*keys, F.coalesce(F.col(mask).cast("boolean"), F.lit(False)).alias(f"__{tag}"), *(F.col(c).cast("double").alias(f"{tag}_{c}") for c in columns)), keys, tag)
    a, b = side(new, "new"), side(old, "old").withColumnsRenamed({k: f"__{k}" for k in keys})
    both = a.join(b, reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[f"__{k}"]) for k in keys)), "full")
    n, o = F.col("__new"), F.col("__old")
    use = F.coalesce(n & o, F.lit(False))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"new_{c}").alias("x"), F.col(f"old_{c}").alias("y")) for c in columns))
    long = both.select(n.alias("n"), o.alias("o"), use.alias("use"), F.inline(each))
    odd = F.col("use") & (F.col("x").isNull() != F.col("y").isNull())
    out = long.groupBy("column").agg(
        F.count_if("use").alias("n_common"), F.count_if(F.col("n") != F.col("o")).alias("mask_disagreements"), F.count_if(F.col("o").isNull()).alias("only_new"), F.count_if(F.col("n").isNull()).alias("only_old"),
        F.max(F.when(F.col("use"), F.abs(F.col("x") - F.col("y")))).alias("max_abs"), F.count_if(odd).alias("__odd"),
    )
    clean = (F.col("mask_disagreements") + F.col("only_new") + F.col("only_old") + F.col("__odd") == 0) & (F.coalesce("max_abs", F.lit(0.0)) <= tolerance)
    return out.withColumn("same", clean).drop("__odd")
