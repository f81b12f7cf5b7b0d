import pytest

import __spark_entry__ as entry
from checks.run import compare, connect

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(request):
    return connect("/root/testdata/sf0.001")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    result, rows, _ = compare(spark, con, sf_dir, QUERIES[name], ORACLE.get(name))
    assert result in ("ok", "rows-only"), result
    assert rows >= 0
