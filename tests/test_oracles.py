"""Every catalog query against its oracle on the smallest tables."""

from pathlib import Path

import pytest

from pathwise import catalog
from tests.compare import differences, second_engine

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return second_engine(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees(spark, con, name):
    assert differences(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
