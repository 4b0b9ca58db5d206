"""Joins in space and time: bilinear and spatio-temporal grid joins, nearest neighbours, inverse-distance weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import geo
from aerolith.sources.text import staged


def corners(lat: Column, lon: Column, step: float = 30.0, n_lat: int = 7, n_lon: int = 12) -> Column:
    """Array of structs a, o, w: grid cells (latitude from 90 down, longitude from 0) and weights; latitude clamps, longitude wraps."""
    y = F.greatest(F.lit(0.0), F.least(F.lit(float(n_lat - 1)), (90 - lat) / step))
    x = F.pmod(lon, F.lit(360.0)) / step
    a0 = F.least(F.floor(y), F.lit(n_lat - 2))
    o0 = F.floor(x) % n_lon
    fy, fx = y - a0, x - F.floor(x)
    cell = lambda a, o, w: F.struct(a.cast("long").alias("a"), o.cast("long").alias("o"), w.alias("w"))
    o1 = (o0 + 1) % n_lon
    return F.array(cell(a0, o0, (1 - fy) * (1 - fx)), cell(a0, o1, (1 - fy) * fx), cell(a0 + 1, o0, fy * (1 - fx)), cell(a0 + 1, o1, fy * fx))


def bilinear(points: DataFrame, field: DataFrame) -> DataFrame:
    """id, t, value of points (id, t, lat, lon) in field (t, a, o, v): four weighted cells per point, an equi join, a sum."""
    cells = points.select("id", "t", F.explode(corners(F.col("lat"), F.col("lon"))).alias("c")).select("id", "t", "c.*")
    return cells.join(field, ["t", "a", "o"]).groupBy("id", "t").agg(F.sum(F.col("w") * F.col("v")).alias("value"))


def spatiotemporal(points: DataFrame, field: DataFrame) -> DataFrame:
    """id, value of points (id, lat, lon, tpos): bilinear in space, linear between the slices around tpos."""
    t0 = F.floor("tpos")
    f = F.col("tpos") - t0
    slices = F.array(F.struct(t0.alias("t"), (1 - f).alias("wt")), F.struct((t0 + 1).alias("t"), f.alias("wt")))
    both = points.select("id", "lat", "lon", F.explode(slices).alias("s"))
    cells = both.select("id", F.col("s.t").alias("t"), F.col("s.wt").alias("wt"), F.explode(corners(F.col("lat"), F.col("lon"))).alias("c")).select("id", "t", "wt", "c.*")
    return cells.join(field, ["t", "a", "o"]).groupBy("id").agg(F.sum(F.col("wt") * F.col("w") * F.col("v")).alias("value"), F.count("*").alias("n_cells"))


#: Places of a group of on columns that are compared without cells; points of a cell, as a multiple of the neighbours asked for.
SMALL_GROUP, CROWDED = 1000, 50
#: Kilometres: from half the earth's circumference down, each half as wide as the one before.
RADII = tuple(math.pi * geo.EARTH_KM * 1.001 / 2**k for k in range(16))


def _vector(lat: str = "latitude", lon: str = "longitude") -> dict[str, Column]:
    a, o = F.radians(lat), F.radians(lon)
    return {"__x": F.cos(a) * F.cos(o), "__y": F.cos(a) * F.sin(o), "__z": F.sin(a)}


def _cell(edge: float, places: DataFrame) -> DataFrame:
    """places with __cell: the cube of that edge, in a unit sphere, that holds the place. Cubes know no poles and no date line."""
    return places.withColumn("__cell", F.struct(*(F.floor(F.col(c) / edge).cast("int").alias(c[-1]) for c in ("__x", "__y", "__z"))))


def _around(edge: float, places: DataFrame) -> DataFrame:
    """places once for each of the 27 cubes around and at theirs."""
    steps = F.array(*(F.struct(*(F.lit(s).alias(c) for s, c in zip((i, j, k), "xyz", strict=True))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))
    own = _cell(edge, places)
    moved = F.transform(steps, lambda s: F.struct(*((F.col("__cell")[c] + s[c]).alias(c) for c in "xyz")))
    return own.withColumn("__near", F.explode(moved)).drop("__cell").withColumnRenamed("__near", "__cell")


def _reach(edge: float) -> float:
    """Kilometres: all places nearer than this lie in the 27 cubes."""
    return geo.EARTH_KM * 2 * math.asin(min(1.0, edge / 2)) - 1e-3


def _crowd(places: DataFrame, on: list[str], edge: float) -> int:
    return _cell(edge, places).groupBy(*on, "__cell").agg(F.sum("__n").alias("n")).agg(F.max("n")).first()[0] or 0


def nearest(targets: DataFrame, points: DataFrame, key: str, most: int, on: tuple[str, ...] = (), apart: str | None = None, within_km: float | None = None) -> DataFrame:
    """on, target, neighbour, rank, km, bearing, latitude, longitude, lat_b, lon_b: the nearest points of each target that agree in on, exactly.

    Both sides have key (one row a key and group of on; whole numbers or text), latitude, longitude, on and apart. Points
    whose apart (else key) is the target's are left out; ties go by key; with within_km nothing farther is listed. Rows
    with a null in any of these columns, on either side, have no neighbours and are none.

    Places meet, not rows: targets of a group that share place and apart have the same neighbours, which are found once
    and handed to all of them; points of one place are first cut to the few keys that any target can need. So the work on
    pairs grows with the places of a group, and rows only take what was found. Groups of few places are compared whole;
    of each place's pairs those stay that lie within a radius that holds enough points. In other groups places meet by
    cells, never by distance. A round joins them on (on, cell), 27 cells a place; places whose last neighbour is nearer
    than anything outside these cells can be are done, the others go on with cells three times as wide. Cells start so
    narrow that none is crowded.
    """
    # Without apart, a target leaves out itself alone: its place looks for one neighbour more.
    itself, on = apart in (None, key), list(on)
    side = lambda df, *names: df.select(*on, *(F.col(c).alias(n) for c, n in zip((key, *(() if itself else (apart,)), "latitude", "longitude"), names, strict=True))).na.drop()
    t = staged(side(targets, "target", *(() if itself else ("__apart",)), "latitude", "longitude"), "targets")
    b = t.withColumnsRenamed({"target": "neighbour", "__apart": "__other", "latitude": "lat_b", "longitude": "lon_b"}) if points is targets else side(points, "neighbour", *(() if itself else ("__other",)), "lat_b", "lon_b")
    wanted, who = (most + 1, [*on, "latitude", "longitude"]) if itself else (most, [*on, "latitude", "longitude", "__apart"])
    first = lambda by, n: F.row_number().over(Window.partitionBy(*on, "lat_b", "lon_b", *by).orderBy("neighbour")) <= n
    if not itself:  # a target leaves one apart out, which has most keys here at most: 2 x most keys hold the first most of any others
        b = b.withColumn("__few", first(["__other"], most)).where("__few")
    b = b.withColumn("__few", first([], wanted if itself else 2 * most)).where("__few")
    point = F.struct("neighbour", *(() if itself else ("__other",)))
    # A place and its few points; __sole: the only apart that has any, if one has all of them.
    sole = [] if itself else [F.when(F.min("__other") == F.max("__other"), F.min("__other")).alias("__sole")]
    b = b.groupBy(*on, "lat_b", "lon_b").agg(F.collect_list(point).alias("__points"), F.count("*").alias("__n"), *sole).withColumns(_vector("lat_b", "lon_b"))
    b = staged(b, "points")
    # Points of a place that one who asks can use, at least: a place of several aparts has one of another.
    usable = F.col("__n") if itself else F.when(F.col("__sole") == F.col("__apart"), F.lit(0)).when(F.col("__sole").isNull(), F.lit(1)).otherwise(F.col("__n"))
    km = geo.distance(F.col("latitude"), F.col("longitude"), F.col("lat_b"), F.col("lon_b"))
    rounded = F.round("km", 6)

    def ranked(pairs: DataFrame, reach: float) -> DataFrame:
        """A row with its neighbours for each who is done: nothing outside the cells can be nearer. pairs: who and places, with km."""
        pairs = pairs.withColumn("__km", rounded).withColumn("__usable", usable).where("__usable > 0")
        nearer = F.sum("__usable").over(Window.partitionBy(*who).orderBy("__km").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        level = F.sum("__usable").over(Window.partitionBy(*who, "__km"))
        pairs = pairs.withColumn("__before", nearer - level).where(F.col("__before") < wanted)
        rows = pairs.select(*who, "km", "__km", "lat_b", "lon_b", F.inline("__points"))
        rows = rows if itself else rows.where(F.col("__apart") != F.col("__other"))
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*who).orderBy("__km", "neighbour"))).where(F.col("rank") <= wanted)
        rows = rows.withColumn("bearing", geo.bearing(F.col("latitude"), F.col("longitude"), F.col("lat_b"), F.col("lon_b")))
        found = rows.groupBy(*who).agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "km", "bearing", "lat_b", "lon_b"))).alias("__found"))  # wanted a place at most
        if reach >= (math.inf if within_km is None else within_km):
            return found
        return found.where((F.size("__found") == wanted) & (F.array_max(F.transform("__found", lambda x: x["km"])) < reach))

    def met(some: DataFrame, near: DataFrame, by: list[str]) -> DataFrame:
        pairs = some.join(near, by).withColumn("km", km)
        return pairs.where(F.col("km") <= within_km) if within_km is not None else pairs

    def whole(some: DataFrame, near: DataFrame) -> DataFrame:
        """Pairs of groups of few places within the least radius that holds enough points."""
        held = met(some, near.drop("__points"), on).withColumn("__usable", usable)
        sums = held.groupBy(*who).agg(*(F.sum(F.when(F.col("km") <= r, F.col("__usable")).otherwise(0)).alias(f"__r{k}") for k, r in enumerate(RADII)))
        cut = F.lit(RADII[0])
        for k, r in enumerate(RADII[1:], 1):
            cut = F.when(F.col(f"__r{k}") >= wanted, F.lit(r)).otherwise(cut)
        cuts = sums.select(*who, (cut + 1e-5).alias("__cut"))  # what rounds to the same distance may lie beyond
        return met(cuts, near, on).where(F.col("km") <= F.col("__cut")).drop("__cut")

    asking = t.select(*who).distinct()
    done = []
    if on:
        sizes = b.groupBy(*on).agg(F.count("*").alias("__size"))
        large = sizes.where(F.col("__size") > SMALL_GROUP).select(*on)
        some_large = bool(large.limit(1).count())
        few = (lambda df: df.join(large, on, "left_anti")) if some_large else (lambda df: df)
        done.append(ranked(whole(few(asking), few(b)), math.inf))
        if some_large:
            asking, b = asking.join(large, on, "left_semi"), staged(b.join(large, on, "left_semi"), "points")
    if not on or some_large:
        left, edge = staged(asking.withColumns(_vector()), "targets"), 2.0
        while edge > 1e-6 and _crowd(b, on, edge) > CROWDED * most:
            edge /= 3
        while True:
            last = edge >= 2
            found = ranked(met(_around(edge, left).drop("__x", "__y", "__z"), _cell(edge, b).drop("__x", "__y", "__z"), [*on, "__cell"]), math.inf if last else _reach(edge))
            found = found if last else staged(found, "nearest")
            done.append(found)
            if last:
                break
            left = staged(left.join(found, who, "left_anti"), "targets")
            edge = min(2.0, edge * 3) if left.limit(1).count() else 2.0
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    found = F.filter("__found", lambda x: x["neighbour"] != F.col("target")) if itself else F.col("__found")
    out = t.join(out, who).select(*on, "target", "latitude", "longitude", F.posexplode(F.slice(found, 1, most)).alias("__k", "x"))
    return out.select(*on, "target", (F.col("__k") + 1).alias("rank"), "x.neighbour", "x.km", "latitude", "longitude", "x.lat_b", "x.lon_b", "x.bearing")


def neighbours(left: DataFrame, right: DataFrame, key: str, most: int) -> DataFrame:
    """target, neighbour, rank, km, bearing: the nearest stations, the target itself left out."""
    return nearest(left, right, key, most).select("target", "neighbour", "rank", "km", "bearing")


def within(targets: DataFrame, points: DataFrame, key: str, radii: tuple[float, ...]) -> DataFrame:
    """target, within_ + radius: points that near, the target's own row left out if it is one of them. Cells are as wide as the largest radius; a place is one row with its count."""
    edge = 2 * math.sin(min(math.pi, max(radii) / geo.EARTH_KM) / 2) + 1e-6
    b = points.select(F.col(key).alias("__key"), F.col("latitude").alias("lat_b"), F.col("longitude").alias("lon_b")).na.drop()
    places = _cell(edge, b.groupBy("lat_b", "lon_b").agg(F.count("*").alias("__n")).withColumns(_vector("lat_b", "lon_b"))).drop("__x", "__y", "__z")
    own = b.groupBy("__key").agg(F.min(F.struct("lat_b", "lon_b")).alias("__own"))
    t = targets.select(F.col(key).alias("target"), "latitude", "longitude").na.drop().withColumns(_vector())
    km = geo.distance(F.col("latitude"), F.col("longitude"), F.col("lat_b"), F.col("lon_b"))
    pairs = _around(edge, t).join(places, "__cell").withColumn("km", km)
    counts = pairs.groupBy("target").agg(*(F.sum(F.when(F.col("km") <= r, F.col("__n")).otherwise(0)).alias(f"__{k}") for k, r in enumerate(radii)))
    both = t.join(counts, "target", "left").join(own, F.col("target") == F.col("__key"), "left")
    self_km = geo.distance(F.col("latitude"), F.col("longitude"), F.col("__own.lat_b"), F.col("__own.lon_b"))
    return both.select("target", *((F.coalesce(f"__{k}", F.lit(0)) - F.when(self_km <= r, 1).otherwise(0)).cast("long").alias(f"within_{r:g}") for k, r in enumerate(radii)))


def inverse_distance(near: DataFrame, values: DataFrame, power: float = 2.0, floor: float = 1e-3) -> DataFrame:
    """target, prediction, n: values (neighbour, value) weighted by 1 / distance ** power."""
    w = 1 / F.pow(F.greatest("km", F.lit(floor)), F.lit(power))
    return near.join(values, "neighbour").groupBy("target").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("prediction"), F.count("*").alias("n"))
