"""Every registered query against its SQL, at the smallest scale."""

import pytest

from oracle import compare, connect
from pitsignal.catalog import QUERIES


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, data, name):
    assert compare(spark, con, QUERIES[name], data) is None


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:3] == ["truck", "metric", "timestamp"]
    assert set(entry.oracle_sql()) < set(entry.queries())
