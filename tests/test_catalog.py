import pytest

from memlake.plans import catalog
from memlake.session import prepare
from oracle import compare, there


@pytest.mark.skipif(not there, reason="no driver tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, name):
    prepare(spark)
    compare(spark, catalog.QUERIES[name], catalog.ORACLES[name])


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.skipif(not there, reason="no driver tables")
def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["query_id", "doc_id", "score", "rank"] and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
