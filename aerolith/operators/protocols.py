"""Units, station metadata and licences: what a table has to pass before it counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.functions import geo

#: Ranges that a station's coordinates and elevation lie in.
LATITUDE, LONGITUDE, ELEVATION = (-90.0, 90.0), (-180.0, 180.0), (-500.0, 9000.0)


def converted(value: Column, unit: Column, kind: str, by: list[str]) -> Column:
    """Pressure in hPa, temperature in K, humidity in kg/kg, height in m: by the unit's text, else by what a profile's values look like.

    A profile (the rows of by) whose median pressure is over 2000 is in Pa, one whose median temperature is under 100 in
    degrees Celsius, one whose 95th percentile of humidity is over 0.2 in g/kg, one whose median height is under 200 in
    km. A null unit tells nothing; a profile without values has none to convert. Profiles are few rows each.
    """
    name = F.coalesce(F.replace(F.lower(unit), F.lit(" "), F.lit("")), F.lit(""))
    over = Window.partitionBy(*by)
    like = lambda c: F.coalesce(c, F.lit(False))
    if kind == "pressure":
        return F.when((name.contains("pa") & ~name.contains("hpa")) | like(F.median(value).over(over) > 2000), value / 100.0).otherwise(value)
    if kind == "temperature":
        return F.when(name.isin("c", "degc", "degree_celsius") | like(F.median(value).over(over) < 100), value + 273.15).otherwise(value)
    if kind == "humidity":
        return F.when((name.contains("g/kg") & ~name.contains("kg/kg")) | like(F.percentile(value, F.lit(0.95)).over(over) > 0.2), value / 1000.0).otherwise(value)
    if kind == "height":
        return F.when(name.contains("km") | like(F.median(F.abs(value)).over(over) < 200), value * 1000.0).otherwise(value)
    raise ValueError(f"unknown kind {kind}")


def classified(stations: DataFrame) -> DataFrame:
    """stations with exclusion_reason and metadata_issue (texts, parts joined by ;, empty if none). Nulls and NaNs are outside every range."""

    def outside(name: str, ends: tuple[float, float]) -> Column:
        return ~F.coalesce(F.col(name).between(*map(F.lit, ends)) & ~F.isnan(name), F.lit(False))

    reasons = F.concat_ws(";", F.when(outside("latitude", LATITUDE), "invalid_latitude"), F.when(outside("longitude", LONGITUDE), "invalid_longitude"))
    return stations.withColumns({"exclusion_reason": reasons, "metadata_issue": F.when(outside("elevation_m", ELEVATION), "missing_station_elevation").otherwise("")})


def stations_by_use(stations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept stations (an elevation out of range is null), excluded ones with their reasons, and an issue row for each station with one."""
    c = classified(stations)
    kept = c.where("exclusion_reason = ''").withColumn("elevation_m", F.when(F.col("metadata_issue") == "", F.col("elevation_m"))).drop("exclusion_reason")
    return kept, c.where("exclusion_reason <> ''"), c.where("metadata_issue <> ''")


#: Roles of a licence that speak of a block, the part of the station split they take, and whether its rows lie in the block.
BLOCK_ROLES = {"block_in": (None, True), "block_out": ("train", False), "block_out_early_val": ("early_val", False), "block_out_calibration": ("calibration", False)}


def licensed(rows: DataFrame, split: DataFrame, matrix: list[tuple[str, str, str, str, str]], block: str | None = None) -> DataFrame:
    """rows with protocol and phase, once for each line of the matrix (protocol, phase, role, first time, first time after it) that licenses them.

    split: station_no, role. A role is a part of the split; those of BLOCK_ROLES take rows in, or out of, the 30 by 60
    degree block named latN_lonM. Rows meet lines by (role); the matrix is as long as a protocol has phases.
    """
    parts = [r.role for r in split.select("role").distinct().collect()]
    lines = []
    for protocol, phase, role, low, high in matrix:
        of, inside = BLOCK_ROLES.get(role, (role, None))
        if inside is not None and block is None:
            raise ValueError(f"{protocol}, {phase}: role {role} needs a block")
        lines += [(protocol, phase, p, inside, low, high) for p in ([of] if of else parts)]
    few = rows.sparkSession.createDataFrame(lines, "protocol string, phase string, role string, __inside boolean, __low string, __high string")
    both = rows.join(F.broadcast(split), "station_no").join(F.broadcast(few), "role")
    here = geo.block(F.col("latitude"), F.col("longitude")) == F.lit(block)
    t = F.col("time")
    return both.where((t >= F.col("__low").cast("timestamp")) & (t < F.col("__high").cast("timestamp")) & (F.col("__inside").isNull() | (F.col("__inside") == here))).drop("__inside", "__low", "__high")


def unused(found: DataFrame, matrix: list[tuple[str, str, str, str, str]]) -> list[tuple[str, str]]:
    """(protocol, phase) of the matrix's lines that license no row."""
    have = {(r.protocol, r.phase) for r in found.select("protocol", "phase").distinct().collect()}
    return sorted({x[:2] for x in matrix} - have)
