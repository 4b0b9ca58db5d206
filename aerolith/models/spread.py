"""Scale models of errors: one value, one a level, log-linear, boosted; cross-fitted errors and calibration by level."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.models import boosting, linear
from aerolith.operators.quantiles import quantiles

#: Least scale, and bounds of its logarithm.
FLOOR, LOW, HIGH = 0.05, -5.0, 4.0
#: A row that lies on its bound is inside: bounds are wider by this factor than what sums in another order may change.
ON_BOUND = 1 + 1e-9
FOLDS = 5


def folds_table(rows: DataFrame, features: list[str], targets: list[str], fold: str, plan: boosting.Plan, folds: int = FOLDS, edges: list[np.ndarray] | None = None) -> boosting.Table:
    """Training rows by fold, of which each counts in the models of all folds but its own."""
    return boosting.table(rows.where(F.col(fold).between(0, folds - 1)), features, targets, fold, plan.bins, folds - 1, edges)


def crossfitted(rows: DataFrame, features: list[str], targets: list[str], fold: str, plan: boosting.Plan, folds: int = FOLDS, of: boosting.Table | None = None) -> DataFrame:
    """rows with oof_ + target: predictions of trees that haven't seen the row's fold. The models of all folds grow together of one table (of, if it is there), each row in all but its own; rows are not copied for it."""
    of = folds_table(rows, features, targets, fold, plan, folds) if of is None else of
    held = [k for k in range(folds) if any(g != k for g in of.groups)]
    model = boosting.grown(of, plan, held, [[i for i, k in enumerate(held) if k != g] for g in of.groups])
    model.by = "__held"
    return model.transform(rows.withColumn("__held", F.col(fold).cast("int")), "oof_").drop("__held")


def log_error(error: Column) -> Column:
    return F.when(error.isNotNull(), F.log(F.greatest(F.abs(error), F.lit(FLOOR))))


def bounded(log_scale: Column) -> Column:
    return F.when(log_scale.isNotNull(), F.exp(F.least(F.lit(HIGH), F.greatest(F.lit(LOW), log_scale))))


def loglinear(rows: DataFrame, features: list[str], error: str, rounds: int = 25, tolerance: float = 1e-7) -> tuple[linear.Linear, int]:
    """Gaussian errors whose log variance is linear in the features: the likelihood's maximum by scoring, and the rounds it took.

    Products of features are summed once. Each round adds up what the squared errors, divided by the variance they are
    given so far, say of each feature: as many sums as features, from one aggregation. A model of the log of sigma.
    """
    known = rows.select(*features, error).na.drop()
    (m,) = linear.moments(known, features, None)
    mean, deviation = (np.array([m[f"{p}{k}"] for k in range(len(features))]) for p in "ms")
    kept = np.flatnonzero(deviation > 1e-12 * np.maximum(1, np.abs(mean)))
    z = [F.lit(1.0)] + [(F.col(features[k]) - float(mean[k])) / float(deviation[k]) for k in kept]
    gram = np.eye(len(z))
    gram[1:, 1:] = linear.products(known, features, None, [0], mean[None])[0][np.ix_(kept, kept)] / np.outer(deviation[kept], deviation[kept]) / m.n
    square = F.col(error) * F.col(error)
    beta = np.zeros(len(z))
    beta[0] = math.log(max(known.agg(F.avg(square)).first()[0], FLOOR**2))
    done = 0
    for done in range(1, rounds + 1):
        variance = F.exp(sum(float(b) * x for b, x in zip(beta, z, strict=True)))
        score = known.agg(*(F.avg(x * (square / variance - 1)).alias(f"s{k}") for k, x in enumerate(z))).first()
        step = np.linalg.solve(gram, np.array([score[f"s{k}"] for k in range(len(z))]))
        beta += step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < tolerance:
            break
    w = np.zeros(len(features))
    w[kept] = beta[1:] / deviation[kept] / 2
    keep = np.isin(np.arange(len(features)), kept)
    return linear.Linear(features, ["log_scale"], None, [0], keep[None], w[None, None], np.array([[beta[0] / 2 - w @ mean]])), done


def calibrated(rows: DataFrame, error: Column, scale: Column, level: str, coverage: float, z: float) -> DataFrame:
    """level, factor: what scale has to be multiplied by so that coverage of the level's errors lies within z of it; 'pooled' factor beside it for levels without rows.

    One row a level, with pooled, the factor of all rows.
    """
    ratio = error / scale
    at_least = lambda c: F.greatest(c / z, F.lit(1e-6))
    some = rows.where(scale > 0)
    each = quantiles(some, F.abs(ratio), [level], [coverage]).select(level, at_least(F.col("q")).alias("factor"))
    every = quantiles(some, F.abs(ratio), [], [coverage]).select(at_least(F.col("q")).alias("pooled"))
    return each.join(F.broadcast(every))  # one row


def with_factor(rows: DataFrame, factors: DataFrame, level: str, name: str) -> DataFrame:
    """rows with name: the level's factor, the pooled one for a level that calibration hasn't seen, 1 if it has seen none. factors: a row a level."""
    few = factors.select(F.col(level).alias("__level"), F.col("factor").alias("__factor"))
    pooled = factors.agg(F.max("pooled").alias("__pooled"))
    both = rows.join(F.broadcast(few), rows[level].eqNullSafe(few["__level"]), "left").join(F.broadcast(pooled))
    return both.withColumn(name, F.coalesce("__factor", "__pooled", F.lit(1.0))).drop("__level", "__factor", "__pooled")
