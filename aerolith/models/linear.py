"""Ridge regression on any fixed number of features by normal equations: one aggregation for moments, one for products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_GROUPS, MOST_COLUMNS = 256, 512


@dataclass
class Linear:
    features: list[str]
    targets: list[str]
    by: str | None
    groups: list
    kept: np.ndarray  # group, feature: False if nearly constant
    coefficients: np.ndarray  # group, target, feature
    intercepts: np.ndarray  # group, target

    def transform(self, rows: DataFrame, prefix: str = "linear_") -> DataFrame:
        """rows with prefix + target; null for groups that the model hasn't seen and where a feature is null. Coefficients are a broadcast row a group."""

        def guess(w, b) -> Column:
            return sum((F.col(f) * w(k) for k, f in enumerate(self.features)), b)

        if self.by is None:
            return rows.withColumns({f"{prefix}{t}": guess(lambda k, i=i: F.lit(float(self.coefficients[0, i, k])), F.lit(float(self.intercepts[0, i]))) for i, t in enumerate(self.targets)})
        listed = [(g, [[*map(float, self.coefficients[j, i]), float(self.intercepts[j, i])] for i in range(len(self.targets))]) for j, g in enumerate(self.groups)]
        kind = rows.schema[self.by].dataType.simpleString()
        few = rows.sparkSession.createDataFrame(listed, f"__by {kind}, __w array<array<double>>")
        both = rows.join(F.broadcast(few), rows[self.by].eqNullSafe(few["__by"]), "left")
        last = len(self.features)
        return both.withColumns({f"{prefix}{t}": guess(lambda k, i=i: F.col("__w")[i][k], F.col("__w")[i][last]) for i, t in enumerate(self.targets)}).drop("__by", "__w")


def moments(rows: DataFrame, columns: list[str], by: str | None) -> list:
    """group, n, means and deviations, a row a group, in order of groups."""
    key = F.col(by) if by else F.lit(0)
    found = rows.groupBy(key.alias("g")).agg(F.count("*").alias("n"), *(f(F.col(c).cast("double")).alias(f"{p}{k}") for k, c in enumerate(columns) for f, p in ((F.avg, "m"), (F.stddev_pop, "s")))).limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS:
        raise ValueError(f"{by} has over {MOST_GROUPS} groups")
    return sorted(found, key=lambda r: (r.g is not None, r.g))


def products(rows: DataFrame, columns: list[str], by: str | None, groups: list, center: np.ndarray) -> np.ndarray:
    """Sums of products of centered columns by group: tasks add up matrices, Spark adds those of tasks up by place."""
    p = len(columns)
    if p > MOST_COLUMNS:
        raise ValueError(f"over {MOST_COLUMNS} columns")
    given = rows.select((F.col(by) if by else F.lit(0)).alias("g"), *(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = {g: i for i, g in enumerate(groups)}, np.zeros((len(groups), p, p))
        for batch in batches:
            at = np.fromiter((place[g] for g in batch.column(0).to_pylist()), np.int64, batch.num_rows)
            x = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(p)], 1)
            for g in np.unique(at):
                z = x[at == g] - center[g]
                total[g] += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "v"])

    found = given.mapInArrow(run, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).toArrow()  # p x p a group
    out = np.zeros(len(groups) * p * p)
    out[found.column("place").to_numpy()] = found.column("v").to_numpy()
    return out.reshape(len(groups), p, p)


def fit(rows: DataFrame, features: list[str], targets: list[str], by: str | None = None, penalty: float = 1.0, scaled: bool = False) -> Linear:
    """Ridge with an unpenalised intercept; scaled: the penalty is on standardised features. Rows with a null are left out.

    Features whose deviation is at most 1e-12 of their mean (or of 1) within a group get no coefficient there. The driver
    solves one p x p system a group by Cholesky; p doesn't depend on the number of rows.
    """
    columns = [*features, *targets]
    known = rows.select(*([by] if by else []), *columns).na.drop(subset=columns)
    found = moments(known, columns, by)
    if not found:
        raise ValueError("no rows to learn from")
    groups, p = [r.g for r in found], len(features)
    mean = np.array([[r[f"m{k}"] for k in range(len(columns))] for r in found])
    deviation = np.array([[r[f"s{k}"] for k in range(len(columns))] for r in found])
    grams = products(known, columns, by, groups, mean)
    kept = deviation[:, :p] > 1e-12 * np.maximum(1, np.abs(mean[:, :p]))
    w, b = np.zeros((len(groups), len(targets), p)), np.zeros((len(groups), len(targets)))
    for g, gram in enumerate(grams):
        k = np.flatnonzero(kept[g])
        scale = deviation[g, k] if scaled else np.ones(len(k))
        a = gram[np.ix_(k, k)] / np.outer(scale, scale) + penalty * np.eye(len(k))
        low = np.linalg.cholesky(a) if len(k) else a
        for t in range(len(targets)):
            if len(k):
                w[g, t, k] = np.linalg.solve(low.T, np.linalg.solve(low, gram[k, p + t] / scale)) / scale
            b[g, t] = mean[g, p + t] - w[g, t] @ mean[g, :p]
    return Linear(features, targets, by, groups, kept, w, b)


def support(rows: DataFrame, training: DataFrame, features: list[str], by: str | None = None, tolerance: float = 1e-12) -> DataFrame:
    """rows with supported: each feature that is nearly constant in training (by group) has that value here. A group without training rows isn't supported.

    The training side is a row a group, at most MOST_GROUPS.
    """
    found = moments(training, features, by)
    near = lambda m, s: s <= tolerance * max(1.0, abs(m))
    listed = [(r.g, [r[f"m{k}"] if r[f"m{k}"] is not None and near(r[f"m{k}"], r[f"s{k}"]) else None for k in range(len(features))]) for r in found]
    few = rows.sparkSession.createDataFrame(listed, f"__by {rows.schema[by].dataType.simpleString() if by else 'int'}, __fixed array<double>")
    both = rows.join(F.broadcast(few), (rows[by] if by else F.lit(0)).eqNullSafe(few["__by"]), "left")
    fixed = lambda k: F.col("__fixed")[k]
    ok = F.col("__fixed").isNotNull()
    for k, f in enumerate(features):
        ok = ok & F.coalesce(fixed(k).isNull() | (F.abs(F.col(f) - fixed(k)) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(fixed(k)))), F.lit(False))
    return both.withColumn("supported", ok).drop("__by", "__fixed")
