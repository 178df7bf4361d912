import datetime as dt

from pyspark.sql import functions as F

from failurelens.operators import store
from failurelens.operators.similarity import top_k_similar
from failurelens.schemas import FAILURE_RECORD


def _records(spark, rows):
    return spark.createDataFrame(rows, FAILURE_RECORD)


def _rec(rid, cluster, emb, ts, task="t"):
    return (rid, task, "code", "tb", cluster, emb, None, ts)


T0 = dt.datetime(2024, 1, 1)


def test_store_filter_counts(spark, tmp_dir):
    assert store.read_store(spark, tmp_dir + "/none").count() == 0
    store.write_batch(_records(spark, [_rec("r1", "Logic", [0.1] * 10, T0)]), tmp_dir + "/s", 1)
    s = store.read_store(spark, tmp_dir + "/s")
    assert store.by_cluster(s, "Logic").count() == 1
    assert store.total_count(s).first().total == 1
    assert {r.failure_cluster: r.cnt for r in store.count_by_cluster(s).collect()} == {"Logic": 1}


def test_latest_batch_wins_and_a_replay_rewrites_itself(spark, tmp_dir):
    path = tmp_dir + "/s"
    store.write_batch(_records(spark, [_rec("r1", "Logic", [1.0], T0, "old"), _rec("r2", "Syntax", [], T0)]), path, 1)
    for _ in range(2):
        store.write_batch(_records(spark, [_rec("r1", "Runtime", [1.0], T0, "new")]), path, 2)
    s = {r.record_id: r for r in store.read_store(spark, path).collect()}
    assert s["r1"].task == "new" and s["r1"].failure_cluster == "Runtime"
    assert s["r2"].embedding is None  # empty embedding stored as NULL
    old = {r.record_id: r.task for r in store.read_store(spark, path, upto=1).collect()}
    assert old == {"r1": "old", "r2": "t"}
    assert store.read_batches(spark, path).count() == 3
    assert store.read_store(spark, path, columns=["failure_cluster"]).columns == ["record_id", "seq", "failure_cluster"]


def test_upsert_replaces_stored_rows(spark):
    cur = store.upsert(None, _records(spark, [_rec("a", "Logic", None, T0, "a1"), _rec("b", "Logic", None, T0, "b1")]))
    got = store.upsert(cur, _records(spark, [_rec("b", "Syntax", None, T0, "b2"), _rec("c", "Logic", None, T0, "c1")]))
    assert {r.record_id: r.task for r in got.collect()} == {"a": "a1", "b": "b2", "c": "c1"}


def test_state_keeps_two_versions(spark, tmp_dir):
    path, schema = tmp_dir + "/state", "x int"
    from pyspark.sql import types as T
    st = T.StructType.fromDDL(schema)
    assert store.read_state(spark, path, st) is None
    for v in range(4):
        store.write_state(spark.createDataFrame([(v,), (10 + v,)], schema), path, v)
        store.write_state(spark.createDataFrame([(v,), (10 + v,)], schema), path, v)  # replayed
    assert sorted(r.x for r in store.read_state(spark, path, st).collect()) == [3, 13]
    assert sorted(r.x for r in store.read_state(spark, path, st, 2).collect()) == [2, 12]
    assert store.read_state(spark, path, st, 1).count() == 0
    import os
    assert sorted(d for d in os.listdir(path) if d.startswith("slot")) == ["slot=0", "slot=1"]


def test_claim(spark, tmp_dir):
    import pytest
    store.claim(spark, tmp_dir, "one")
    store.claim(spark, tmp_dir, "one")
    with pytest.raises(ValueError):
        store.claim(spark, tmp_dir, "two")


def test_batch_duplicates_later_wins(spark):
    b = _records(spark, [_rec("r1", "Logic", None, T0, "first"), _rec("r1", "Logic", None, T0, "second")]) \
        .withColumn("seq", F.monotonically_increasing_id())
    got = store.upsert(None, b).collect()
    assert len(got) == 1 and got[0].task == "second"


def test_unknown_label_becomes_unknown(spark):
    got = store.upsert(None, _records(spark, [_rec("r1", "Weird", None, T0)])).first()
    assert got.failure_cluster == "Unknown"


def test_similarity_top1(spark):
    s = _records(spark, [_rec("a", "Logic", [1.0, 0.0, 0.0], T0, "Task 1"), _rec("b", "Logic", [0.0, 1.0, 0.0], T0, "Task 2")])
    top = store.search_similar(s, [0.9, 0.1, 0.0], top_k=1).collect()
    assert len(top) == 1 and top[0].task == "Task 1"


def test_recency_tie_break(spark):
    s = _records(spark, [_rec("b", "Logic", None, T0), _rec("a", "Logic", None, T0),
                         _rec("c", "Logic", None, T0 + dt.timedelta(1))])
    assert [r.record_id for r in store.recent(s, 3).collect()] == ["c", "a", "b"]
    per = store.recent_per_cluster(s, 2).orderBy("rank").collect()
    assert [r.record_id for r in per] == ["c", "a"]


def test_many_query_top_k_matches_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    vecs = rng.standard_normal((200, 8))
    qs = rng.standard_normal((5, 8))
    st = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "record_id long, embedding array<double>")
    q = spark.createDataFrame([(j, [float(x) for x in v]) for j, v in enumerate(qs)], "query_id long, query_vec array<double>")
    got = top_k_similar(st.repartition(7), q, k=3).collect()
    en = vecs / (np.linalg.norm(vecs, axis=1, keepdims=True) + 1e-8)
    qn = qs / (np.linalg.norm(qs, axis=1, keepdims=True) + 1e-8)
    sims = qn @ en.T
    for j in range(5):
        want = list(np.argsort(-sims[j], kind="stable")[:3])
        have = [r.record_id for r in sorted((r for r in got if r.query_id == j), key=lambda r: r["rank"])]
        assert have == want
    # scoring in small query blocks gives the same answer
    got_blocks = top_k_similar(st.repartition(3), q, k=3, block_cells=60).collect()
    assert sorted((r.query_id, r.record_id) for r in got_blocks) == sorted((r.query_id, r.record_id) for r in got)
    # chunked path (query set above the broadcast bound) gives the same answer
    got2 = top_k_similar(st, q, k=3, max_broadcast=2).collect()
    assert sorted((r.query_id, r.record_id) for r in got2) == sorted((r.query_id, r.record_id) for r in got)


def test_upsert_with_a_hot_key(spark):
    # one record id holds a third of all rows; latest seq must win, others untouched
    n = 3000
    rows = [(("hot" if i % 3 == 0 else f"r{i}"), f"task{i}", "c", "tb", "Logic", None, None, T0, i) for i in range(n)]
    df = spark.createDataFrame(rows, "record_id string, task string, code string, traceback string, "
                                     "failure_cluster string, embedding array<float>, "
                                     "repair_trace struct<trajectory_id:string,steps:array<struct<agent:string,"
                                     "action:string,reasoning:string,output:string>>,repair_reasoning:string,"
                                     "repaired_code:string,verified:boolean,num_attempts:int>, "
                                     "created_at timestamp, seq long").repartition(11)
    got = {r.record_id: r.task for r in store.upsert(None, df).collect()}
    assert got["hot"] == f"task{max(i for i in range(n) if i % 3 == 0)}"
    assert len(got) == 1 + sum(1 for i in range(n) if i % 3 != 0)


def test_top_k_ids_that_repeat_and_emitted_rows(spark):
    import numpy as np
    import pandas as pd

    from failurelens.operators.similarity import _local_top_k
    st = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "record_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])] * 7 + [(2, [0.0, 1.0])] * 5, "query_id long, query_vec array<double>")
    got = top_k_similar(st.repartition(3), q, k=3, max_broadcast=1).collect()
    assert sorted((r.query_id, r.record_id) for r in got) == [(1, 47), (1, 48), (1, 49), (2, 0), (2, 1), (2, 2)]
    rng = np.random.default_rng(1)
    batches = [pd.DataFrame({"id": range(b * 5, b * 5 + 5), "vec": list(rng.standard_normal((5, 4)))}) for b in range(40)]
    out = pd.concat(_local_top_k(np.arange(6), rng.standard_normal((6, 4)), 3)(iter(batches)))
    assert len(out) == 18
