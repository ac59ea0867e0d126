"""Every query of the library proper against its SQL, or that it runs."""

import pytest

from siltworks.registry import ORACLES, QUERIES
from tests.checks import SF, assert_same, connection


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_hash_route(spark):
    import zlib

    for r in QUERIES["hash_route"](spark, SF).collect():
        assert r["model"] == zlib.crc32(f"call-{r['doc_id']}".encode()) % 3
