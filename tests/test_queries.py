"""Every query of the catalogue: against DuckDB where there is SQL, else that it runs with a stable schema."""

import pytest

from margrave.plans import catalogue

from .oracle import SMALL, compare

#: Queries that train classifiers; covered by tests of their parts and by one of each kind here.
SLOW = {"discriminator_rf", "utility_rf", "discriminator_lr"}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, name):
    compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - SLOW))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
