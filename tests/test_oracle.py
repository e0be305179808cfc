"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

from __future__ import annotations

import pytest

from matchlight import plans

from . import oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connection(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_as_sql(spark, con, sf_dir, name):
    assert oracle.compare(spark, con, name, plans.QUERIES[name], plans.ORACLES[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).limit(1).count() == 1
