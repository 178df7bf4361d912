import pytest

import __spark_entry__ as entry_mod
from failurelens.plans.compare import compare, duckdb_connection
from failurelens.plans.oracle import ORACLE
from failurelens.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and set(df.columns) == {"benchmark", "metric", "value"}


# iterative queries: rows-only checks by design
NO_ORACLE = {"kmeans_fit"}


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES) - NO_ORACLE
    assert set(QUERIES) <= set(entry_mod.queries()) and set(ORACLE) <= set(entry_mod.oracle_sql())


@pytest.mark.parametrize("name", sorted(NO_ORACLE))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0


@pytest.fixture(scope="module")
def duck():
    return duckdb_connection(SF)


SPARK_TO_DUCK = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN", "FloatType()": "FLOAT"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF)
    err = compare(sdf, duck, ORACLE[name])
    assert err is None, err
    # column types agree too (not only values)
    dtypes = {r[0]: r[1] for r in duck.execute("DESCRIBE " + ORACLE[name]).fetchall()}
    for f in sdf.schema.fields:
        assert SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType)) == dtypes[f.name], (name, f.name)
