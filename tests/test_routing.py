import numpy as np
from pyspark.sql import functions as F

from failurelens.operators import routing


def test_routing_branches(spark):
    rows = [(True, False, 0, 3), (False, False, 0, 3), (False, True, 1, 3), (False, False, 1, 3), (False, False, 3, 3)]
    df = spark.createDataFrame(rows, "success boolean, repair_verified boolean, attempt int, max_attempts int")
    got = df.select(routing.after_execution().alias("e"),
                    routing.after_repair("repair_verified", "attempt", "max_attempts").alias("r"),
                    routing.after_re_execution("success", "attempt", "max_attempts").alias("x")).collect()
    assert [g.e for g in got] == ["success_store", "failure_analysis", "failure_analysis", "failure_analysis",
                                  "failure_analysis"]
    assert [g.r for g in got[2:]] == ["re_execute", "expert_repair", "distillation"]
    assert got[0].x == "distillation" and got[3].x == "failure_analysis" and got[4].x == "distillation"


def test_topology_nodes_per_run():
    t = {run: routing.edge_targets(rep, dis) for run, rep, dis, _, _ in
         [("run0", False, False, 0, 0), ("run1", True, False, 0, 0), ("run2", True, True, 0, 0),
          ("run3", False, True, 0, 0), ("run4", True, True, 0, 0)]}
    assert {tgt for _, _, tgt in t["run0"]} == {"success_store"}
    assert "distillation" not in {tgt for _, _, tgt in t["run1"]}
    assert "distillation" in {tgt for _, _, tgt in t["run2"]}
    assert {e for e, _, _ in t["run3"]} == {"after_execution"}
    assert t["run2"] == t["run4"]


def test_bucketed_running_count_equals_window(spark):
    rng = np.random.default_rng(0)
    n = 3000
    keys = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 20, n))  # one hot key
    df = spark.createDataFrame([(int(k), i, bool(rng.random() < 0.5)) for i, k in enumerate(keys)],
                               "task_id long, sample_id long, success boolean")
    a = routing.with_attempts(df, buckets=(4, 64, 256)).select("sample_id", F.col("attempt").alias("a"))
    b = routing.with_attempts(df, buckets=()).select("sample_id", F.col("attempt").alias("b"))
    assert a.join(b, "sample_id").where("a != b").count() == 0
    assert a.count() == n


def test_stages_chain_with_transform(spark):
    from failurelens.functions.execlog import parse_exec_log
    from failurelens.sources import fixtures
    out = (fixtures.exec_log(spark, "/root/testdata/sf0.001")
           .transform(parse_exec_log)
           .transform(routing.with_attempts)
           .withColumn("next_stage", routing.after_execution()))
    row = out.groupBy().agg(F.max("attempt").alias("m"), F.count(F.lit(1)).alias("n")).first()
    assert row.n == 1000 and row.m > 0


def test_running_count_keeps_null_keys_and_orders(spark):
    rows = [(k, o, o is None or o % 3 == 0) for k in ("a", "b", None) for o in (None, 0, 1, 2, 5, 8, 9, 70, 71, 300)]
    df = spark.createDataFrame(rows, "key string, ord long, flag boolean").repartition(3)
    plain = routing.running_count(df, "key", "ord", F.col("flag"), "n", buckets=())
    want = sorted(plain.collect(), key=str)
    assert len(want) == len(rows)
    for buckets in ((4,), (4, 64), (2, 8, 100), routing.BUCKETS):
        got = routing.running_count(df, "key", "ord", F.col("flag"), "n", buckets=buckets)
        assert sorted(got.select(plain.columns).collect(), key=str) == want
