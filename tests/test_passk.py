import pytest
from pyspark.sql import functions as F

from failurelens.functions.passk import pass_at_k
from failurelens.operators import evaluate

CASES = [(10, 10, 1, 1.0), (5, 5, 3, 1.0), (10, 0, 1, 0.0), (5, 0, 3, 0.0), (5, 4, 2, 1.0),
         (5, 3, 3, 1.0), (2, 1, 1, 0.5), (3, 1, 2, 2 / 3)]


def test_pass_at_k_values(spark):
    df = spark.createDataFrame(CASES, "n int, c int, k int, expected double")
    rows = df.select("expected", pass_at_k("n", "c", "k").alias("got")).collect()
    for r in rows:
        assert r.got == pytest.approx(r.expected)


def test_pass_at_k_zero_k(spark):
    assert spark.range(1).select(pass_at_k(5, 2, 0).alias("p")).first().p == 0.0


@pytest.mark.parametrize("n,c,k", [(3, 1, 4), (3, 4, 1), (-1, 0, 1)])
def test_pass_at_k_invalid_raises(spark, n, c, k):
    with pytest.raises(Exception):
        spark.range(1).select(pass_at_k(n, c, k)).collect()


def test_batch_mean(spark):
    counts = spark.createDataFrame([("task_1", 3, 2), ("task_2", 3, 0), ("task_3", 3, 3)], "task_id string, n int, c int")
    got = evaluate.mean_pass_at_k(counts, ks=(1,)).first()
    assert got.pass_at_1 == pytest.approx(5 / 9)
    assert got.num_problems == 3


def test_empty_batch_is_zero(spark):
    counts = spark.createDataFrame([], "task_id string, n int, c int")
    assert evaluate.mean_pass_at_k(counts, ks=(1,)).first().pass_at_1 == 0.0


def test_monotone_in_k_and_c(spark):
    rows = [(10, c, k) for c in range(11) for k in range(1, 11)]
    df = spark.createDataFrame(rows, "n int, c int, k int").select("n", "c", "k", pass_at_k("n", "c", "k").alias("p"))
    vals = {(r.c, r.k): r.p for r in df.collect()}
    for c in range(11):
        for k in range(1, 10):
            assert vals[(c, k)] <= vals[(c, k + 1)] + 1e-12
    for k in range(1, 11):
        for c in range(10):
            assert vals[(c, k)] <= vals[(c + 1, k)] + 1e-12


def test_missing_samples_count_as_incorrect(spark):
    tasks = spark.createDataFrame([("a",), ("b",)], "task_id string")
    results = spark.createDataFrame([("a", True), ("a", False)], "task_id string, success boolean")
    counts = evaluate.correct_counts(results, tasks=tasks, num_samples=5)
    got = {r.task_id: (r.n, r.c) for r in counts.collect()}
    assert got == {"a": (5, 1), "b": (5, 0)}


def test_benchmark_metric_names(spark):
    counts = spark.createDataFrame([("HumanEval", "t1", 5, 1)], "benchmark string, task_id string, n int, c int")
    names = {r.metric for r in evaluate.benchmark_metrics(counts).collect()}
    assert names == {"humaneval/pass@1", "humaneval/pass@5", "humaneval/num_problems"}


def test_merge_metrics_later_wins(spark):
    a = spark.createDataFrame([("m1", 1.0), ("m2", 2.0)], "metric string, value double")
    b = spark.createDataFrame([("m2", 3.0)], "metric string, value double")
    got = {r.metric: r.value for r in evaluate.merge_metrics(a, b).collect()}
    assert got == {"m1": 1.0, "m2": 3.0}


def test_expand_samples(spark):
    t = spark.createDataFrame([("a",), ("b",)], "task_id string")
    assert evaluate.expand_samples(t, 3).count() == 6
    assert F is not None


def test_fixed_n_counts_the_whole_log(spark):
    from math import comb

    from failurelens.functions.execlog import parse_exec_log
    from failurelens.plans.queries import QUERIES
    from failurelens.sources import fixtures
    sf = "/root/testdata/sf0.001"
    users = {str(r[0]) for r in fixtures.table(spark, sf, "customer").select("c_custkey").collect()}
    log = parse_exec_log(fixtures.exec_log(spark, sf)).select("task_id", "success").collect()
    size, right = {}, {u: 0 for u in users}
    for r in log:
        size[r.task_id] = size.get(r.task_id, 0) + 1
        right[r.task_id] = right.get(r.task_id, 0) + bool(r.success)
    n = max(5, *size.values())
    want = {f"users/pass@{k}": sum(1 - comb(n - c, k) / comb(n, k) for c in right.values()) / len(right) for k in (1, 5)}
    got = {r.metric: r.value for r in QUERIES["pass_at_k_fixed_n"](spark, sf).collect()}
    assert got == pytest.approx({**want, "users/num_problems": len(right)}, abs=1e-6)


def test_task_stages_take_every_example(spark):
    from failurelens.plans.queries import QUERIES
    from failurelens.sources import fixtures
    sf = "/root/testdata/sf0.001"
    last = {}
    for r in fixtures.training_examples(spark, sf).select("source_task_id", "seq").collect():
        last[r.source_task_id] = max(r.seq, last.get(r.source_task_id, r.seq))
    got = {r.task_id: r.example_attempt for r in QUERIES["task_stages"](spark, sf).collect()}
    assert got and got == {t: last.get(t) for t in got}
