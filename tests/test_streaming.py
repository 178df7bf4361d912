import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from failurelens.operators import buffer as buf
from failurelens.operators import cluster
from failurelens.operators.store import read_batches, read_state, read_store, write_state
from failurelens.schemas import BUFFER_ROW, CENTROIDS
from failurelens.sources import fixtures
from failurelens.streaming import streams

SF = "/root/testdata/sf0.001"


def _write_parts(df, path, n):
    """Write ``df`` as ``n`` JSON files (one per part), in seq order."""
    parts = df.withColumn("_p", F.pmod(F.col("seq"), F.lit(n)))
    for i in range(n):
        parts.where(F.col("_p") == i).drop("_p").coalesce(1).write.mode("overwrite").json(f"{path}/_stage{i}")
        src = [f for f in os.listdir(f"{path}/_stage{i}") if f.endswith(".json")][0]
        os.rename(f"{path}/_stage{i}/{src}", f"{path}/part{i:03d}.json")
    return [parts.where(F.col("_p") == i).drop("_p") for i in range(n)]


def _wait(q):
    q.awaitTermination(300)
    assert q.exception() is None


def test_event_log_stream_equals_batch(spark, tmp_dir):
    ev = fixtures.table(spark, SF, "events").limit(50)
    rows = streams.event_rows(ev, "execution_completed", "user_id", passed="value", kind="event_type")
    log_dir = os.path.join(tmp_dir, "events")
    streams.log_events(rows, log_dir)
    batch = streams.read_events(spark, log_dir)
    q = (streams.event_stream(spark, log_dir).writeStream.format("memory").queryName("ev_tail")
         .option("checkpointLocation", os.path.join(tmp_dir, "ck1")).trigger(availableNow=True).start())
    _wait(q)
    got = spark.table("ev_tail")
    assert got.count() == batch.count() == 50
    assert got.select("event").distinct().first().event == "execution_completed"
    assert batch.select(F.try_variant_get("payload", "$.kind", "string").alias("k")).where("k is null").count() == 0


def test_running_counts_stream_equals_batch(spark, tmp_dir):
    recs = fixtures.failure_batch(spark, SF).drop("vec_key")
    src = os.path.join(tmp_dir, "src")
    _write_parts(recs, src, 3)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in recs.schema.fields])
    stream = streams.json_stream(spark, src, schema, max_files_per_trigger=1)
    q = streams.start_counts_to_table(stream, os.path.join(tmp_dir, "counts"), "counts", os.path.join(tmp_dir, "ck2"))
    _wait(q)
    counts = T.StructType.fromDDL("cluster_name string, n bigint")
    table = read_state(spark, os.path.join(tmp_dir, "counts"), counts, 2)
    got = {r.cluster_name: r.n for r in table.collect()}
    want = {r.failure_cluster: r["count"] for r in recs.groupBy("failure_cluster").count().collect()}
    assert got == want


def test_online_clustering_stream_equals_batch(spark, tmp_dir):
    vecs = fixtures.vectors(spark, SF).select("seq", F.col("vec_id").cast("string").alias("record_id"),
                                               F.lit("task").alias("task"), F.lit("code").alias("code"),
                                               F.lit("").alias("traceback"), "embedding",
                                               F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("created_at"))
    src = os.path.join(tmp_dir, "vsrc")
    groups = _write_parts(vecs, src, 3)
    c0 = fixtures.label_anchor_centroids(spark, SF).select("cluster_idx", "cluster_name", "centroid")
    cents = os.path.join(tmp_dir, "cents")
    write_state(c0, cents, 0)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in vecs.schema.fields])
    stream = streams.json_stream(spark, src, schema, max_files_per_trigger=1)
    q = streams.start_online_clustering(stream, os.path.join(tmp_dir, "store"), cents, "online",
                                        checkpoint=os.path.join(tmp_dir, "ck3"))
    _wait(q)
    # batch twin: the same three groups, one after another
    cur = c0
    for g in groups:
        cur = cluster.ema_update(g, cur, alpha=0.1).select("cluster_idx", "cluster_name", "centroid")
        cur = spark.createDataFrame(cur.collect(), CENTROIDS)
    want = {r.cluster_idx: r.centroid for r in cur.collect()}
    got = {r.cluster_idx: r.centroid for r in read_state(spark, cents, CENTROIDS, 3).collect()}
    assert set(got) == set(want)
    for i in want:
        assert max(abs(a - b) for a, b in zip(got[i], want[i])) < 1e-9
    store = read_store(spark, os.path.join(tmp_dir, "store"))
    assert store.count() == vecs.count()
    assert store.where(F.col("failure_cluster") == "Unknown").count() == 0


def test_buffer_stream_equals_batch(spark, tmp_dir):
    ex = fixtures.training_examples(spark, SF)
    src = os.path.join(tmp_dir, "bsrc")
    _write_parts(ex, src, 3)
    stream = streams.json_stream(spark, src, BUFFER_ROW, max_files_per_trigger=1)
    q = streams.start_buffer(stream, os.path.join(tmp_dir, "buf"), "buffer", capacity=100,
                             checkpoint=os.path.join(tmp_dir, "ck4"))
    _wait(q)
    got = sorted(r.seq for r in read_state(spark, os.path.join(tmp_dir, "buf"), stream.schema).collect())
    want = sorted(r.seq for r in buf.fifo(ex, 100).collect())
    assert got == want


def test_event_fields_keep_their_types(spark, tmp_dir):
    import json
    df = spark.createDataFrame([("t1", 3, True, 0)], "task_id string, passed int, success boolean, attempt int")
    path = os.path.join(tmp_dir, "ev")
    streams.log_events(streams.stage_events(df, "execution_completed"), path)
    line = json.loads(spark.read.text(path).first().value)
    assert (line["event"], line["passed"], line["success"], line["attempt"]) == ("execution_completed", 3, True, 0)
    assert "total" not in line and len(streams.STAGE_EVENTS) == 9


def _vector_stream(spark, tmp_dir, name, ids):
    src = os.path.join(tmp_dir, name)
    rows = [(i, f"r{i}", "task", "code", "", [float(i % 3 == j) for j in range(3)]) for i in ids]
    df = spark.createDataFrame(rows, "seq long, record_id string, task string, code string, traceback string, "
                                     "embedding array<float>")
    df.coalesce(1).write.mode("append").json(src)
    return streams.json_stream(spark, src, df.schema, max_files_per_trigger=1)


def test_a_restarted_stream_keeps_all_batches(spark, tmp_dir):
    """The checkpoint is found by name under spark.checkpoint.dir, so a second start goes on."""
    store_path, cents, name = os.path.join(tmp_dir, "store"), os.path.join(tmp_dir, "cents"), f"s{os.path.basename(tmp_dir)}"
    for ids in (range(0, 30), range(30, 45)):
        _wait(streams.start_online_clustering(_vector_stream(spark, tmp_dir, "src", ids), store_path, cents, name))
    assert streams.stream_checkpoint(spark, name) == os.path.join(spark.conf.get("spark.checkpoint.dir"), "streams", name)
    assert {r.batch_id for r in read_batches(spark, store_path).select("batch_id").distinct().collect()} == {1, 2}
    assert sorted(int(r.record_id[1:]) for r in read_store(spark, store_path).collect()) == list(range(45))
    assert read_state(spark, cents, CENTROIDS).count() == 6  # it began without centroids


def test_another_checkpoint_is_refused(spark, tmp_dir):
    import pytest
    store_path, cents = os.path.join(tmp_dir, "store"), os.path.join(tmp_dir, "cents")
    stream = _vector_stream(spark, tmp_dir, "src", range(25))
    _wait(streams.start_online_clustering(stream, store_path, cents, "one", checkpoint=os.path.join(tmp_dir, "ck1")))
    with pytest.raises(ValueError):
        streams.start_online_clustering(stream, store_path, cents, "two", checkpoint=os.path.join(tmp_dir, "ck2"))
    assert read_store(spark, store_path).count() == 25
