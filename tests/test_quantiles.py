import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.operators import quantiles


@pytest.mark.parametrize("cells,few", [(16, 3), (2048, 5000)])
def test_quantiles_against_numpy(spark, cells, few):
    """Ties, one value, heavy tails, nulls, NaNs and a null group; few=3 refines until cells have few values."""
    rng = random.Random(cells)
    groups = {"a": [rng.gauss(0, 1) for _ in range(500)], "b": [rng.choice([1.0, 2.0, 5.0]) for _ in range(300)], "c": [7.0] * 50, "d": [math.copysign(10 ** rng.uniform(-3, 3), rng.random() - 0.5) for _ in range(200)], None: [1e308, -1e308, 0.0], "e": [3.5]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("a", None), ("a", float("nan")), ("z", None)]
    rng.shuffle(rows)
    probabilities = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    found = quantiles.quantiles(spark.createDataFrame(rows, "g string, x double"), F.col("x"), ["g"], probabilities, cells, few).collect()
    assert len(found) == len(groups) * len(probabilities)
    for r in found:
        xs = groups[r.g]
        assert r.n == len(xs) and r.p == probabilities[r.k]
        s = sorted(xs)
        at = r.p * (len(xs) - 1)
        want = s[math.floor(at)] + (s[math.ceil(at)] - s[math.floor(at)]) * (at - math.floor(at))
        assert r.q == pytest.approx(want, rel=1e-12), (r, want)
        assert np.isclose(r.q, want)


def test_quantiles_of_nothing(spark):
    assert quantiles.quantiles(spark.createDataFrame([], "x double"), F.col("x"), [], [0.5]).count() == 0
