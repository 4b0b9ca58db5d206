"""Exact quantiles by refined histograms: counts per cell, then only the cells that hold a wanted rank, again and again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolith.sources.text import staged

#: Cells of a histogram; values of a cell that are sorted as they are.
CELLS = 2048
FEW = 5000


def quantiles(rows: DataFrame, value: Column, by: list[str], probabilities: list[float], cells: int = CELLS, few: int = FEW) -> DataFrame:
    """by, k (place in probabilities), p, q, n (values of the group): linear between the two nearest ranks, as quantile_cont has it.

    Nulls and NaNs are left out; values are finite. A group without values has no rows. Each round reads what is left of
    the values once: a count, a least and a largest value for each cell, so no task ever holds a group's values. A cell's
    next histogram lies between its own least and largest value, so each round tells at least two values apart; cells of
    one value or of few values end it. Groups of equal values take one round.
    """
    v = rows.select(*by, value.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    v = staged(v.withColumn("cell", F.lit("")), "values")
    same = lambda *more: [*by, "cell", *more]
    found = v.groupBy(*same()).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).withColumn("before", F.lit(0).cast("long"))
    asked = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(probabilities)))
    wanted = found.select(*by, F.col("n").alias("total"), F.inline(asked)).withColumn("at", F.col("p") * (F.col("total") - 1))
    ranks = wanted.select(*by, F.inline(F.array(*(F.struct(x.cast("long").alias("rank")) for x in (F.floor("at"), F.ceil("at")))))).distinct().withColumn("cell", F.lit(""))
    # A group is a cell at first; live: a row for each wanted rank, with the cell that holds it.
    live = staged(_joined(ranks, found, same()), "ranks")
    done = []
    while True:
        done.append(live.where("low = high").select(*by, "rank", F.col("low").alias("v")))
        live = live.where("low < high")
        size = live.agg(F.max("n")).first()[0]
        if size is None:
            break
        held = live.groupBy(*same()).agg(F.first("low").alias("low"), F.first("high").alias("high"), F.first("n").alias("n"), F.first("before").alias("before"))
        kept = _joined(v, held.drop("n", "before"), same())
        if size <= few:
            lists = kept.groupBy(*same()).agg(F.sort_array(F.collect_list("v")).alias("vs"))  # few values each
            done.append(_joined(live, lists, same()).select(*by, "rank", F.element_at("vs", (F.col("rank") - F.col("before") + 1).cast("int")).alias("v")))
            break
        width = F.col("high") / 2 - F.col("low") / 2  # no overflow
        number = F.least(F.lit(cells - 1), F.floor((F.col("v") / 2 - F.col("low") / 2) / width * cells))
        v = staged(kept.select(*same("v"), number.cast("int").alias("c")), "values")
        counts = v.groupBy(*same("c")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        order = Window.partitionBy(*same()).orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
        counts = _joined(counts, held.select(*same(), F.col("before").alias("first")), same()).withColumn("before", F.col("first") + F.coalesce(F.sum("n").over(order), F.lit(0)))
        inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
        live = _joined(live.select(*same("rank")), counts.drop("first"), same()).where(inside)
        live = staged(live.withColumn("cell", F.concat_ws(".", "cell", "c")).drop("c"), "ranks")
        v = v.select(*by, "v", F.concat_ws(".", "cell", "c").alias("cell"))
    values = done[0]
    for more in done[1:]:
        values = values.unionByName(more)
    both = _joined(wanted.withColumn("rank", F.floor("at").cast("long")), values, [*by, "rank"])
    upper = values.select(*by, F.col("rank").alias("above"), F.col("v").alias("w"))
    both = _joined(both.withColumn("above", F.ceil("at").cast("long")), upper, [*by, "above"])
    return both.select(*by, "k", "p", (F.col("v") + (F.col("w") - F.col("v")) * (F.col("at") - F.col("rank"))).alias("q"), F.col("total").alias("n"))


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner equi join in which nulls are equal; the columns of on are left's."""
    renamed = right.withColumnsRenamed({c: f"__{c}" for c in on})
    match = F.lit(True)
    for c in on:
        match = match & left[c].eqNullSafe(renamed[f"__{c}"])
    return left.join(renamed, match).drop(*(f"__{c}" for c in on))
