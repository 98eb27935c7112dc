"""Every query with a SQL counterpart gives the same rows; the others give sound rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from thermoband.plans.queries import QUERIES

ORACLES = entry.oracle_sql()
WITHOUT_SQL = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["treatment", "daytime", "Prairie", "Rookery", "diff"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    assert len(got) > 0
    assert difference(got, duck.execute(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_model_query_rows(spark, sf_dir, name):
    rows = entry.queries()[name](spark, sf_dir)
    reals = [c for c, t in rows.dtypes if t == "double"]
    assert reals
    bad = " OR ".join(f"`{c}` IS NULL OR isnan(`{c}`)" for c in reals)
    rows = rows.cache()
    assert rows.count() > 0
    assert rows.filter(bad).count() == 0
    rows.unpersist()
