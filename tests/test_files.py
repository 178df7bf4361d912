import json
import os

from pyspark.sql import functions as F

from failurelens.operators import tasks
from failurelens.sources import files


def test_problem_sources(spark, tmp_dir):
    he = os.path.join(tmp_dir, "he.jsonl")
    with open(he, "w") as f:
        f.write(json.dumps({"task_id": "HumanEval/0", "prompt": "def f():", "entry_point": "f", "test": "def check(c): pass",
                            "canonical_solution": "  return 1"}) + "\n\n")
    mb = os.path.join(tmp_dir, "mbpp.jsonl")
    with open(mb, "w") as f:
        f.write(json.dumps({"task_id": 7, "text": "t", "code": "c", "test_list": ["assert 1"]}) + "\n")
    p = files.humaneval_problems(spark, he).withColumn("ordinal", F.lit(0))
    assert p.count() == 1
    pf = files.pipeline_problems(p, max_tasks=1).first()
    assert pf.test_cases[0].test_code == "def check(c): pass"
    m = files.mbpp_problems(spark, mb).first()
    assert m.task_id == "7" and m.test_setup_code == ""


def test_tracker_round_trip(spark, tmp_dir):
    assert files.read_tracker(spark, os.path.join(tmp_dir, "missing.json")).count() == 0
    rows = spark.createDataFrame([(1, "humaneval/pass@1", 0.5), (1, "x", 2.0), (2, "humaneval/pass@1", 0.6)],
                                 "round int, metric string, value double")
    path = os.path.join(tmp_dir, "tracker")
    files.write_tracker(rows, path, started_at="2024-01-01T00:00:00")
    back = files.read_tracker(spark, path)
    assert sorted((r.round, r.metric, r.value) for r in back.collect()) == sorted(
        (r.round, r.metric, r.value) for r in rows.collect())


def test_chat_and_metrics_sinks(spark, tmp_dir):
    from failurelens.functions.text import chat_messages
    ex = spark.createDataFrame([("problème", "", "f", "r", "c")], "problem string, plan string, failed_code string, "
                               "repair_reasoning string, repaired_code string")
    chat = ex.select(chat_messages().alias("messages"))
    files.write_chat_jsonl(chat, os.path.join(tmp_dir, "chat"))
    line = spark.read.text(os.path.join(tmp_dir, "chat")).first().value
    assert "problème" in line and json.loads(line)["messages"][0]["role"] == "system"
    m = spark.createDataFrame([("run", 1, "a", 1.0)], "run_name string, round int, metric string, value double")
    files.append_metrics(m, os.path.join(tmp_dir, "metrics"), step=3)
    files.append_metrics(m, os.path.join(tmp_dir, "metrics"), step=4)
    assert spark.read.parquet(os.path.join(tmp_dir, "metrics")).count() == 2
    files.write_report(m, os.path.join(tmp_dir, "report"))
    assert spark.read.json(os.path.join(tmp_dir, "report")).first().metrics[0].cell == "1.0000"


def test_merge_stages_latest_attempt(spark):
    ex = spark.createDataFrame([("t1", 0, False), ("t1", 1, True), ("t2", 0, False)], "task_id string, attempt int, success boolean")
    rep = spark.createDataFrame([("t1", 0, "code")], "task_id string, attempt int, repaired string")
    m = {r.task_id: r for r in tasks.merge_stages({"exec": ex, "repair": rep}).collect()}
    assert m["t1"].exec_success is True and m["t1"].repair_repaired == "code" and m["t2"].repair_repaired is None
    ok, bad = tasks.split_by_success(ex)
    assert ok.count() == 1 and bad.count() == 2


def test_summary_from_tracker_has_times(spark, tmp_dir):
    from failurelens.operators import reports
    rows = spark.createDataFrame([(1, "humaneval/pass@1", 0.5), (2, "mbpp/pass@5", 0.6)],
                                 "round int, metric string, value double")
    path = os.path.join(tmp_dir, "tracker2")
    files.write_tracker(rows, path)
    long = files.read_tracker(spark, path).withColumn("run_name", F.lit("run4"))
    out = {r["round"]: r for r in reports.experiment_summary(long).collect()}
    assert out[1].key_metrics == "humaneval/pass@1: 0.5000" and out[2].key_metrics == "None"
    assert out[1].total_rounds == 2 and out[1].started_at is not None and out[1].ended_at is not None


def test_buffer_file_without_seq_keeps_line_order(spark, tmp_dir):
    import json

    from failurelens.operators import buffer
    path = tmp_dir + "/buffer.jsonl"
    with open(path, "w") as f:
        for i in range(200):
            f.write(json.dumps({"problem": f"p{i}", "failure_cluster": "Logic", "trajectory_id": f"t{i}"}) + "\n")
            f.write("\n" * (i % 3 == 0))
    rows = files.read_buffer(spark, path)
    assert [r.problem for r in rows.orderBy("seq").collect()] == [f"p{i}" for i in range(200)]
    assert sorted(r.problem for r in buffer.fifo(rows, 5).collect()) == [f"p{i}" for i in range(195, 200)]
    more = buffer.append(rows, rows.drop("seq"), capacity=203)
    assert more.count() == 203 and more.agg(F.max("seq")).first()[0] == 399


def test_indented_trajectory_documents(spark, tmp_dir):
    import json

    import pytest

    from failurelens.operators import trajectories
    for i in range(3):
        doc = {"trajectory_id": f"t{i}", "steps": [{"agent": "debugger", "action": "a", "reasoning": "r", "output": "o"}],
               "repair_reasoning": "", "repaired_code": "x", "verified": True, "num_attempts": 1}
        with open(f"{tmp_dir}/t{i}.json", "w") as f:
            json.dump(doc, f, indent=2)
    got = trajectories.load(spark, tmp_dir, documents=True).collect()
    assert sorted((r.trajectory_id, len(r.steps), r.verified) for r in got) == [(f"t{i}", 1, True) for i in range(3)]
    assert trajectories.load_one(spark, tmp_dir, "t1", documents=True).count() == 1
    with pytest.raises(Exception):
        trajectories.load(spark, tmp_dir).collect()


def test_tracker_keeps_config_and_dataset_stats(spark, tmp_dir):
    rounds = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.7)], "round int, metric string, value double")
    stats = spark.createDataFrame([(2, "examples", 12)], "round int, name string, n long")
    files.write_tracker(rounds, tmp_dir + "/t", "start", {"k": "5"}, stats)
    assert [(r["round"], r["name"], r["n"]) for r in files.read_tracker_stats(spark, tmp_dir + "/t").collect()] == [(2, "examples", 12)]
    assert [tuple(r) for r in files.read_tracker_config(spark, tmp_dir + "/t").collect()] == [("k", "5")]
    assert files.read_tracker(spark, tmp_dir + "/t").count() == 2
    assert files.read_tracker_stats(spark, tmp_dir + "/none").count() == 0


def test_writers_round_trip(spark, tmp_dir):
    from failurelens.operators import buffer, trajectories
    from failurelens.sources import fixtures
    ex = fixtures.training_examples(spark, "/root/testdata/sf0.001").limit(20)
    files.write_buffer(ex, tmp_dir + "/buffer")
    assert sorted(r.seq for r in files.read_buffer(spark, tmp_dir + "/buffer").collect()) == sorted(r.seq for r in ex.collect())
    chat = buffer.round_dataset(ex, 5, None)
    files.write_chat_parquet(chat, tmp_dir + "/chat")
    assert [len(r.messages) for r in spark.read.parquet(tmp_dir + "/chat").collect()] == [3] * 5
    trajectories.save_examples(ex, tmp_dir + "/examples")
    assert spark.read.json(tmp_dir + "/examples").select("problem", "weight").count() == 20


def test_final_fields_and_metric_events(spark):
    from failurelens.operators import reports, trajectories
    df = spark.createDataFrame([("t", "code", "why", None)], "trajectory_id string, c string, w string, v boolean")
    r = trajectories.finalise(df, "c", "w", "v").first()
    assert (r.repaired_code, r.repair_reasoning, r.verified) == ("code", "why", False)
    m = spark.createDataFrame([("m", 1.0, 3)], "metric string, value double, round int")
    r = reports.metric_events(spark, m, step_col="round").first()
    assert r.step == 3 and r.timestamp.startswith("20")


def test_a_benchmark_is_a_loader_and_a_scorer(spark):
    from failurelens.operators.evaluate import BenchmarkRunner

    def load(s):
        return s.createDataFrame([("a",), ("b",)], "task_id string")

    def score(problems):
        return problems.where("task_id = 'a'").select("task_id", F.lit(True).alias("success"))
    got = {r.metric: r.value for r in BenchmarkRunner("Own", load, score, num_samples=2, ks=(1,)).run(spark).collect()}
    assert got == {"own/pass@1": 0.25, "own/num_problems": 2.0}
