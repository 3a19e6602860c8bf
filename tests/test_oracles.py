"""Every query of the library against its SQL, and those without one for rows and columns."""

from __future__ import annotations

import pytest
from conftest import lines

from tidepanel import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
#: Iterative or fitted queries are slow to start; their parts are tested elsewhere.
SLOW = {"j14_forecast_comparison", "k7_two_way_fe_rho", "j8_select_on_validation"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, sf, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert lines(ours) == lines(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_names_agree():
    assert set(ORACLES) <= set(QUERIES)
