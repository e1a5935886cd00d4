"""Every query against its SQL in DuckDB."""

import pytest

from rows import same_rows
from quartzgrid.plans.oracles import oracle_sql
from quartzgrid.plans.queries import queries


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf_dir, duck, name):
    got, want = queries()[name](spark, sf_dir).toPandas(), duck.execute(oracle_sql()[name]).df()
    assert len(want), name
    assert not same_rows(got, want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 160
    assert set(oracle_sql()) <= set(e.oracle_sql()) <= set(e.queries())
