"""Soundings on larger tables: shares of tasks, draws."""

from collections import Counter

from pyspark.sql import functions as F

from aerolith.plans import suites
from aerolith.sources import levels


def test_tasks_of_the_order_join_grow_with_lines(spark, sf, monkeypatch):
    """Rows stay as they are; no task gets much more than its share, with Spark left to merge small partitions."""
    want = Counter(map(tuple, levels.levels(spark, sf).collect()))
    monkeypatch.setattr(levels, "TASK_ROWS", 250)
    rows = levels.levels(spark, sf)
    assert Counter(map(tuple, rows.collect())) == want
    assert max(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()) < 750


def test_draws_are_not_shuffled(spark, sf, capsys):
    """AR10 adds draws up within a profile's row: no plan step makes a row a draw."""
    suites.energy_score(spark, sf).explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "Generate" not in plan
