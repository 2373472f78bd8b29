import pytest

import __spark_entry__ as entry
from gridloom.plans.registry import ORACLES, QUERIES
from tests.support.compare import check


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    assert check(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
