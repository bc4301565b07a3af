import pytest
from pyspark.sql import functions as F

from memlake.llm.queries import ORACLES, QUERIES
from memlake.session import prepare
from oracle import DATA, compare, there

pytestmark = pytest.mark.skipif(not there, reason="no driver tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    prepare(spark)
    compare(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs_on_whole_tables(spark, name):
    prepare(spark)
    out = QUERIES[name](spark, DATA)
    assert out.count() > 0 and len(set(out.columns)) == len(out.columns)


def test_containers_hold_every_document(spark):
    prepare(spark)
    placed = QUERIES["p6_containers"](spark, DATA)
    assert placed.select("doc_id").distinct().count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    used = placed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("u"), F.max("capacity").alias("c"))
    assert used.where("u > c").count() == 0
