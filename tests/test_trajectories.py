from pyspark.sql import functions as F

from failurelens.operators import trajectories as tr


def _steps(spark):
    return spark.createDataFrame([("t1", 0, "Debugger", "generate_repair", "why", "code")],
                                 "trajectory_id string, seq long, agent string, action string, reasoning string, output string")


def test_steps_and_attempts(spark):
    s = tr.trajectory_stats(_steps(spark)).first()
    assert (s.num_steps, s.num_attempts) == (1, 1)
    other = tr.trajectory_stats(_steps(spark), counted_action="analyse_and_repair").first()
    assert other.num_attempts == 0


def test_finalise_save_load_list_convert(spark, tmp_dir):
    finals = spark.createDataFrame([("t1", "fixed", "because", True)],
                                   "trajectory_id string, repaired_code string, repair_reasoning string, verified boolean")
    docs = tr.assemble(_steps(spark), finals)
    tr.save(docs, tmp_dir + "/traj", mode="overwrite")
    back = tr.load_one(spark, tmp_dir + "/traj", "t1").first()
    assert back.trajectory_id == "t1" and len(back.steps) == 1 and back.verified is True
    assert [r.trajectory_id for r in tr.list_ids(spark, tmp_dir + "/traj").collect()] == ["t1"]
    ctx = spark.createDataFrame([("t1", "task", "plan", "bad", "Syntax", "task-1")],
                                "trajectory_id string, task string, plan string, failed_code string, "
                                "failure_cluster string, source_task_id string")
    ex = tr.to_training_examples(back and docs, ctx).first()
    assert ex.failure_cluster == "Syntax" and ex.repaired_code == "fixed" and ex.problem == "task"


def test_missing_trajectory_gives_empty_repair(spark):
    docs = tr.assemble(_steps(spark))
    ctx = spark.createDataFrame([("t9", "task", "", "bad", "syntax", None)],
                                "trajectory_id string, task string, plan string, failed_code string, "
                                "failure_cluster string, source_task_id string")
    ex = tr.to_training_examples(docs, ctx).first()
    assert ex.repaired_code == "" and ex.failure_cluster == "Unknown"
    assert tr.quality_filter(tr.to_training_examples(docs, ctx), verified_only=True).count() == 0


def test_deterministic_id_is_stable(spark):
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    a = df.select(tr.deterministic_id("k", "n").alias("i")).first().i
    b = df.repartition(3).select(tr.deterministic_id("k", "n").alias("i")).first().i
    assert a == b and len(a) == 36 and F is not None
