"""Connected components of an edge table by alternating large-star and small-star steps, each a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import staged


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """u, component (the smallest node that u reaches) for every node of edges (u, v: long) that isn't itself the smallest.

    Each round's edges are a table in the shared scratch folder. Nothing but a count and a checksum reaches the driver.
    """
    now = staged(_ordered(edges), "edges", edges.count())
    before = _sum(now)
    for _ in range(most_rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _ordered(both.where("v > u").unionAll(now.select("u", F.col("u").alias("v")).distinct()).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        smaller = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smaller, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(_ordered(small.unionAll(smaller.select("u", F.col("m").alias("v")))), "edges", 2 * before[0])
        if (after := _sum(now)) == before:
            return now.select("u", F.col("v").alias("component"))
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
