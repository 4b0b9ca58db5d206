import __spark_entry__ as entry
import numpy as np
import pytest
from compare import of_duck, of_spark

from aerolith.plans import suites

OWN = {k: f for m in entry.PLANS for k, f in m.Q.items()}
SQL = {k: q for m in entry.PLANS for k, q in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, sf, name):
    assert of_spark(OWN[name](spark, sf)) == of_duck(duck, SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_boosted_trees(spark, sf):
    """Queries without SQL are tested in test_models.py, but this one. These tables' residuals are noise for the most part, so later errors may differ little from those without a correction."""
    assert set(OWN) - set(SQL) == {"ML3", "ML4", "ML6_heteroscedastic", "ML9", "ML13", "ML15"}
    rows = OWN["ML3"](spark, sf).collect()
    want = suites.predicted(spark, sf).where(f"time >= '{suites.DEV}'").groupBy("pressure_hpa").count().collect()
    assert {(r.pressure_hpa, r.n) for r in rows} == {tuple(r) for r in want}
    assert sum(r.n * r.rmse**2 for r in rows) < 1.1 * sum(r.n * r.rmse_raw**2 for r in rows)


def test_boosted_trees_read_written_rows(spark, sf):
    """Fits and scores read the rows that were written once, not the join of lines and orders again."""
    files = suites.boosted(spark, sf).inputFiles()
    assert files and not any(sf in f for f in files)


def test_eigenvalues_are_floored():
    r = suites.floored(np.full((6, 6), 1.0))
    assert np.allclose(np.diag(r), 1) and np.linalg.eigvalsh(r)[0] > 1e-8 and np.allclose(r, r.T)
