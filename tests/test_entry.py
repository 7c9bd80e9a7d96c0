"""Driver contract: entry smoke, registry shape, oracle equality."""

import pytest

import __spark_entry__ as E
from compare import compare, duck
from tractus.plans.queries import ORACLE, QUERIES

SF_SMALL = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["level", "name", "rank", "lat", "lon", "description"]
    assert {r.level for r in rows} == {"state", "county", "city", "tract"}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL, con)
    assert all(ok), ok
