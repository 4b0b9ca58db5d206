"""Cell-keyed neighbours against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from aerolith.operators import spatial


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def some_points(n, seed):
    """Poles, the date line, one crowded town, places shared by many, lone points; two groups and a null."""
    rng = random.Random(seed)
    town = [(48 + rng.gauss(0, 0.2), 11 + rng.gauss(0, 0.2)) for _ in range(n // 3)]
    rest = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(n // 4)]
    edge = [(90.0, rng.uniform(-180, 180)) for _ in range(5)] + [(rng.uniform(-60, 60), rng.choice([-180, 180, 179.999, -179.999])) for _ in range(10)] + [(-90.0, 0.0)]
    places = town + rest + edge
    places += [places[0]] * (n // 3) + [places[-1]] * 20
    return [(k, rng.choice("ab") if k % 50 else None, f"s{rng.randrange(n // 8)}", *map(float, p)) for k, p in enumerate(places)]


def brute(targets, points, most, grouped, apart, within_km=math.inf):
    out = set()
    for t in targets:
        if None in (t if grouped else (t[0], *t[2:])):
            continue
        near = [(round(km(t[3:], p[3:]), 6), p[0]) for p in points if (p[2] != t[2] if apart else p[0] != t[0]) and (not grouped or p[1] == t[1]) and km(t[3:], p[3:]) <= within_km]
        out |= {(t[0], n, r + 1, f"{d:.5f}") for r, (d, n) in enumerate(sorted(near)[:most])}
    return out


@pytest.mark.parametrize("grouped,apart,most,within_km", [(False, None, 4, None), (True, "station", 3, None), (True, None, 2, 700.0)])
def test_nearest_against_all_pairs(spark, grouped, apart, most, within_km):
    rows = some_points(300, most)
    df = spark.createDataFrame(rows, "id long, g string, station string, latitude double, longitude double")
    found = spatial.nearest(df, df, "id", most, ("g",) if grouped else (), apart, within_km)
    got = [(r.target, r.neighbour, r["rank"], f"{round(r.km, 6):.5f}") for r in found.collect()]
    assert len(got) == len(set(got))
    want = brute(rows, rows, most, grouped, apart, within_km or math.inf)
    # places of equal distance may round to neighbouring digits: distances and ranks decide, then ids
    assert {(t, r, d) for t, _, r, d in got} == {(t, r, d) for t, _, r, d in want}
    assert len(set(got) & want) >= 0.99 * len(want)


def test_no_nested_loop_in_the_plan(spark, capsys):
    df = spark.createDataFrame(some_points(200, 9), "id long, g string, station string, latitude double, longitude double")
    spatial.nearest(df, df, "id", 2, ("g",)).explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_counts_within_radii(spark):
    rows = some_points(240, 5)
    df = spark.createDataFrame(rows, "id long, g string, station string, latitude double, longitude double")
    got = {r.target: (r.within_50, r.within_3000) for r in spatial.within(df, df, "id", (50.0, 3000.0)).collect()}
    assert got == {t[0]: tuple(sum(km(t[3:], p[3:]) <= r for p in rows) - 1 for r in (50, 3000)) for t in rows}


def test_neighbours_of_few_points(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)], "id long, latitude double, longitude double")
    assert spatial.nearest(df, df, "id", 3).count() == 0 == spatial.nearest(df.limit(0), df, "id", 3).count() == spatial.nearest(df, df.limit(0), "id", 3).count()
    two = df.union(spark.createDataFrame([(2, 0.0, 180.0), (3, None, 1.0)], "id long, latitude double, longitude double"))
    assert sorted((r.target, r.neighbour) for r in spatial.nearest(two, two, "id", 3).select("target", "neighbour", F.col("km")).collect()) == [(1, 2), (2, 1)]


def test_context_tensors(spark, sf):
    """Three slots a profile, 19 own and 6 relative features, zeros where nothing stands; policies leave out what they say."""
    from aerolith.plans import suites

    rows = suites.context(spark, sf.replace("sf0.001", "sf0.01")).collect()  # the smaller tables have no two such profiles at a time
    assert rows and all(len(r.slots) == 3 for r in rows) and any(r.n for r in rows)
    for r in rows:
        assert [s.mask for s in r.slots] == [True] * r.n + [False] * (3 - r.n)
        assert all(len(s.own) == 19 and len(s.pair) == 6 and (s.mask or not any(s.own) and not any(s.pair)) for s in r.slots)
        assert r.nearest_km == min([1e6, *(s.km for s in r.slots if s.mask)])
        assert r.profile_no % 3 != 2 or all(s.km >= 500 for s in r.slots)
        for s in r.slots[: r.n]:
            assert s.pair[0] == pytest.approx(math.log(1 + s.km / 100)) and s.pair[1] ** 2 + s.pair[2] ** 2 == pytest.approx(1)


def test_pairs_grow_with_places_not_rows(spark, monkeypatch):
    """2,000 rows at 20 places: places are compared, rows take what was found for theirs."""
    met = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(lat, lon, lat_b, lon_b):
        met.add(1)
        a, o, b, p = map(math.radians, (lat, lon, lat_b, lon_b))
        return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin((p - o) / 2) ** 2)))

    monkeypatch.setattr(spatial.geo, "distance", counted)
    rows = [(k, k % 2, f"s{k // 2 % 20}", float(k // 2 % 20 * 3), float(k // 2 % 20 * 7)) for k in range(2000)]
    df = spark.createDataFrame(rows, "id long, g long, station string, latitude double, longitude double")
    got = [(r.target, r.neighbour, r["rank"], f"{round(r.km, 6):.5f}") for r in spatial.nearest(df, df, "id", 3, ("g",), "station").collect()]
    assert len(got) == 6000 and set(got) == brute(rows, rows, 3, True, True)
    assert met.value <= 20 * 20 * 2 * 10
