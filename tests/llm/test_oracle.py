import pytest

from failurelens.llm.queries import ORACLE, QUERIES
from failurelens.plans.compare import compare, duckdb_connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return duckdb_connection(SF)


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    assert compare(QUERIES[name](spark, SF), duck, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_one_row_for_each_document(spark, name):
    out = QUERIES[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.count() == docs.count() == out.join(docs, "doc_id").count()
