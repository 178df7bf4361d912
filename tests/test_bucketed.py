import uuid

import pytest

from failurelens.operators import bucketed, store


@pytest.fixture()
def table(spark, tmp_dir):
    return "store_" + uuid.uuid4().hex, tmp_dir + "/store"


def batch(spark, rows):
    return spark.createDataFrame(rows, "record_id string, task string, failure_cluster string, seq long")


FIRST = [("a", "t1", "Logic", 1), ("a", "t2", "Syntax", 5), ("b", "t3", "odd", 2), (None, "t4", "Logic", 3)] + \
    [(f"r{i}", "x", "Logic", i) for i in range(40)]
LATER = [("a", "t5", "Runtime", 1), ("c", "t6", "Logic", 9), ("r3", None, None, 2)]


def rows_of(df):
    return sorted((tuple(r) for r in df.select("record_id", "task", "failure_cluster", "seq").collect()), key=str)


def test_upserts_equal_the_plain_store(spark, table):
    name, path = table
    got = bucketed.upsert(spark, name, path, batch(spark, FIRST), 1, buckets=4)
    assert rows_of(got) == rows_of(store.upsert(None, batch(spark, FIRST)))
    got = bucketed.upsert(spark, name, path, batch(spark, LATER), 2, buckets=4)
    want = store.upsert(store.upsert(None, batch(spark, FIRST)), batch(spark, LATER))
    assert rows_of(got) == rows_of(want)
    again = bucketed.upsert(spark, name, path, batch(spark, LATER), 2, buckets=4)  # replayed
    assert rows_of(again) == rows_of(want)
    none = bucketed.upsert(spark, name, path, batch(spark, []), 3, buckets=4)
    assert rows_of(none) == rows_of(want)


def test_only_the_batch_is_shuffled(spark, table):
    name, path = table
    bucketed.upsert(spark, name, path, batch(spark, FIRST), 1, buckets=16)
    stored = bucketed.current(spark, name, path, 1)
    merged = bucketed.merged(stored, batch(spark, LATER), buckets=16)
    merged.collect()
    plan = merged._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "Bucketed: true" in plan
    left = final[final.index("SortMergeJoin"):].split("FileScan")[0]
    assert "Exchange" not in left, final


def test_one_bucket_for_a_record(spark, table):
    name, path = table
    bucketed.upsert(spark, name, path, batch(spark, FIRST), 1, buckets=8)
    one = bucketed.current(spark, name, path, 1).where("record_id = 'b'")
    automatic = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    spark.conf.set(automatic, "false")  # else the plan does not tell of the buckets
    try:
        assert "SelectedBucketsCount: 1 out of 8" in one._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(automatic)
    assert rows_of(one) == [("b", "t3", "Unknown", 2)]


def test_another_session_attaches(spark, table):
    name, path = table
    rows = bucketed.upsert(spark, name, path, batch(spark, FIRST), 1, buckets=4)
    want, schema = rows_of(rows), rows.schema
    spark.sql(f"DROP TABLE {name}_1")
    bucketed.attach(spark, name, path, 1, schema, buckets=4)
    assert rows_of(bucketed.current(spark, name, path, 1)) == want
    assert bucketed.current(spark, name, path, 0) is None
