"""Every registered query of the core against its SQL on the smallest tables."""

import pytest

from rivulet.plans import catalog
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf_dir, name):
    check(spark, sf_dir, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf_dir, name):
    found = catalog.QUERIES[name](spark, sf_dir)
    assert found.count() > 0
