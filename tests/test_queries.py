import pytest
from oracle import compare

import __spark_entry__ as entry
from agora.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_its_sql(spark, name):
    compare(catalog.QUERIES[name](spark, SF), catalog.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r["n_votes"] for r in rows] == sorted((r["n_votes"] for r in rows), reverse=True)
    assert set(entry.oracle_sql()) <= set(entry.queries())
