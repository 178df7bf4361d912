"""Registered end-to-end queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Every query reads the provided tables (or data Spark derives from them) in
full; limits appear only where the limit is the feature (top-k reports,
bounded buffers, samples).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failurelens.functions.execlog import parse_exec_log
from failurelens.operators import evaluate
from failurelens.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- evaluation: P4-P9, A6-A8, J6, P26 ---------------------------------------
@query("pass_at_k_metrics")
def pass_at_k_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = parse_exec_log(fixtures.exec_log(spark, sf_dir))
    counts = evaluate.correct_counts(results, group_cols=["benchmark"])
    metrics = evaluate.benchmark_metrics(counts, ks=(1, 5, 10))
    return metrics.select("benchmark", "metric", r6("value").alias("value"))


@query("exec_results")
def exec_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = parse_exec_log(fixtures.exec_log(spark, sf_dir))
    return res.select("task_id", "sample_id", "passed", "failed", "total", "stderr", "stdout", "returncode",
                      "timeout", "error_type", "traceback", r6("execution_time_ms").alias("execution_time_ms"),
                      "success")


# --- failure text: P1-P3, P31 -------------------------------------------------
@query("failure_text")
def failure_text_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.functions import text as tx
    d = fixtures.failure_text_inputs(spark, sf_dir)
    code = tx.failing_code("repaired_code", "student_code")
    return d.select(
        "doc_id",
        code.alias("failing_code"),
        tx.failure_text("task", code, "error_type", "stderr", "traceback").alias("failure_text"),
        tx.failure_text("task", code, "error_type", "stderr", "traceback",
                        task_limit=10, traceback_limit=9, stderr_limit=5, code_limit=12).alias("failure_text_short"),
        F.length(tx.embed_input("text")).cast("bigint").alias("embed_input_chars"),
        tx.fingerprint(tx.embed_input("text")).alias("embed_input_fp"),
        tx.fingerprint("text").alias("text_fingerprint"),
    )


# --- failure store: K1, K2, W3, S7, A1, A2, T1, T2, F1, F2 ----------------------
def _store(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The upserted failures; with ``columns``, only these besides the key and the order."""
    from failurelens.operators import store
    batch = fixtures.failure_batch_with_embeddings(spark, sf_dir)
    return store.upsert(None, batch.select("record_id", "seq", *columns) if columns else batch)


@query("failure_store")
def failure_store_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.functions.text import iso_utc
    s = _store(spark, sf_dir)
    return s.select("record_id", "task", "code", "traceback", "failure_cluster",
                    iso_utc("created_at").alias("created_at"), "seq",
                    F.coalesce(F.size("embedding"), F.lit(0)).cast("bigint").alias("emb_dim"))


@query("failure_counts")
def failure_counts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from failurelens.operators import cluster
    s = _store(spark, sf_dir, "failure_cluster", "embedding").withColumn("embedding", F.col("embedding").isNotNull())
    # one pass over the store: per-cluster counts (partial aggregate), then
    # totals over the handful of cluster rows
    per = s.groupBy("failure_cluster").agg(F.count(F.lit(1)).alias("n"),
                                           F.count_if("embedding").alias("n_emb"))
    stats = cluster.cluster_stats_from_counts(per, "failure_cluster", "n")
    allw = Window.partitionBy()
    return (stats.join(F.broadcast(per.select(F.col("failure_cluster").alias("cluster_name"), "n_emb")),
                       on="cluster_name", how="left")
            .select("cluster_name", "total_failures", r6("failure_rate").alias("failure_rate"), "recent_trend",
                    F.sum("total_failures").over(allw).alias("store_total"),
                    F.coalesce(F.sum("n_emb").over(allw), F.lit(0)).alias("with_embedding")))


@query("recent_failures_by_cluster")
def recent_by_cluster_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.functions.text import iso_utc
    from failurelens.operators import store
    s = _store(spark, sf_dir, "failure_cluster", "created_at")
    return store.recent_per_cluster(s, 100).select(
        "failure_cluster", F.col("rank").cast("bigint").alias("rank"), "record_id", iso_utc("created_at").alias("created_at"))


@query("recent_failures")
def recent_failures_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.functions.text import iso_utc
    from failurelens.operators import store
    s = _store(spark, sf_dir, "failure_cluster", "created_at")
    return store.recent(s, 1000).select("record_id", "failure_cluster", iso_utc("created_at").alias("created_at"))


# --- vectors: P27, P28, J4, T3, J3, T5, M7, A4, A5, M9 step, M8 minibatch ----------
@query("similar_vectors")
def similar_vectors_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.operators.similarity import top_k_similar
    store = fixtures.vectors(spark, sf_dir)
    q = fixtures.label_query_vectors(spark, sf_dir)
    out = top_k_similar(store, q, k=5, id_col="vec_id", vec_col="embedding")
    return out.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), r6("similarity").alias("similarity"))


@query("similar_vectors_indexed")
def similar_vectors_indexed_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``similar_vectors``, found through a pivot index of all vectors."""
    from failurelens.operators import pivot_index
    index = pivot_index.build_index(fixtures.vectors(spark, sf_dir), id_col="vec_id", vec_col="embedding")
    out, _ = pivot_index.search(index, fixtures.label_query_vectors(spark, sf_dir), k=5, id_col="vec_id")
    return out.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), r6("similarity").alias("similarity"))


@query("cluster_assign")
def cluster_assign_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.operators import cluster
    v = fixtures.vectors(spark, sf_dir)
    c = fixtures.label_anchor_centroids(spark, sf_dir)
    a = cluster.assign(v, c, "embedding")
    return a.select("vec_id", "cluster_idx", "cluster_name", r6("similarity").alias("similarity"))


@query("cluster_stats")
def cluster_stats_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.operators import cluster
    a = cluster.assign(fixtures.vectors(spark, sf_dir), fixtures.label_anchor_centroids(spark, sf_dir))
    s = cluster.cluster_stats(a)
    return s.select("cluster_name", "total_failures", r6("failure_rate").alias("failure_rate"), "recent_trend")


def _explode_centroids(c: DataFrame) -> DataFrame:
    return c.select("cluster_idx", "cluster_name", "n_assigned", F.posexplode("centroid").alias("dim", "v")) \
        .select("cluster_idx", "cluster_name", F.col("n_assigned").cast("bigint").alias("n_assigned"),
                F.col("dim").cast("bigint").alias("dim"), r6("v").alias("value"))


@query("kmeans_step")
def kmeans_step_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.operators import cluster
    step = cluster.lloyd_step(fixtures.vectors(spark, sf_dir), fixtures.label_anchor_centroids(spark, sf_dir))
    return _explode_centroids(step)


@query("centroid_ema")
def centroid_ema_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.operators import cluster
    upd = cluster.ema_update(fixtures.vectors(spark, sf_dir), fixtures.label_anchor_centroids(spark, sf_dir),
                             alpha=0.1, order_col="seq")
    return _explode_centroids(upd)


# --- replay buffer and curriculum: W2, U1, A3, J1, M1-M4, P24, P13 ----------------
#: Below the table's size at every scale, so rows are evicted.
BUFFER_CAPACITY = 500
SAMPLE_N = 1_000


def _buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The example table as a buffer without a capacity."""
    return fixtures.training_examples(spark, sf_dir)


def _store_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.operators import cluster
    return cluster.failure_rates(cluster.cluster_stats(_store(spark, sf_dir, "failure_cluster"), cluster_col="failure_cluster"))


@query("buffer_fifo")
def buffer_fifo_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.operators import buffer
    kept = buffer.fifo(_buffer(spark, sf_dir), BUFFER_CAPACITY)
    return kept.select("seq", "failure_cluster", "problem", "plan", "trajectory_id")


@query("buffer_distribution")
def buffer_distribution_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.operators import buffer
    return buffer.distribution(_buffer(spark, sf_dir))


@query("curriculum_weights")
def curriculum_weights_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.operators import buffer
    w = buffer.with_weights(_buffer(spark, sf_dir), _store_rates(spark, sf_dir), amplification=5.0)
    return w.select("seq", "failure_cluster", r6("raw_weight").alias("raw_weight"),
                    F.round("weight", 12).alias("weight"))


@query("curriculum_sample_uniform")
def sample_uniform_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.operators import buffer
    return buffer.sample_uniform(_buffer(spark, sf_dir), SAMPLE_N, seed=42).select("seq", "failure_cluster")


@query("curriculum_sample_weighted")
def sample_weighted_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.operators import buffer
    s = buffer.sample_weighted(_buffer(spark, sf_dir), SAMPLE_N, _store_rates(spark, sf_dir), seed=42)
    return s.select("seq", "failure_cluster", r6("raw_weight").alias("raw_weight"))


@query("chat_dataset")
def chat_dataset_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.operators import buffer
    d = buffer.round_dataset(_buffer(spark, sf_dir), SAMPLE_N, _store_rates(spark, sf_dir), seed=42)
    return d.select("seq", "failure_cluster",
                    F.col("messages")[0]["content"].alias("system_msg"),
                    F.col("messages")[1]["content"].alias("user_msg"),
                    F.col("messages")[2]["content"].alias("assistant_msg"),
                    F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"))


@query("cluster_labels")
def cluster_labels_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.functions.text import canonical_cluster
    e = fixtures.table(spark, sf_dir, "events").select("event_type").distinct()
    raw = fixtures._event_label()
    lab = e.select("event_type", raw.alias("raw_label"))
    return lab.select("event_type", "raw_label", canonical_cluster("raw_label", "lenient").alias("lenient"),
                      canonical_cluster("raw_label", "strict").alias("strict"),
                      canonical_cluster(F.upper("event_type"), "lenient").alias("upper_lenient"))


# --- routing: W1, C1-C4, J8 -----------------------------------------------------------
def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.operators import routing
    res = parse_exec_log(fixtures.exec_log(spark, sf_dir))
    att = routing.with_attempts(res)
    verified = F.coalesce(F.col("error_type") == "AssertionError", F.lit(False))
    return att.select("task_id", "sample_id", "attempt", "success", verified.alias("repair_verified"),
                      routing.after_execution().alias("after_execution"),
                      routing.after_repair(verified, "attempt").alias("after_repair"),
                      routing.after_re_execution("success", "attempt").alias("after_re_execution"))


@query("routing_labels")
def routing_labels_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)


@query("ablation_funnel")
def ablation_funnel_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.operators import routing
    return routing.funnel(_labels(spark, sf_dir), spark)


# --- trajectories: A9, P21, P23, P25 ----------------------------------------------------
@query("trajectory_summary")
def trajectory_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.operators import trajectories as tr
    s = tr.trajectory_stats(fixtures.trajectory_steps(spark, sf_dir))
    return s.select("trajectory_id", "num_steps", "num_attempts", "first_agent", "last_agent",
                    F.length("last_output").cast("bigint").alias("last_output_chars"))


@query("training_examples")
def training_examples_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.functions.text import repair_reasoning_text
    from failurelens.operators import trajectories as tr
    steps = fixtures.trajectory_steps(spark, sf_dir)
    stats = tr.trajectory_stats(steps)
    verified = F.col("last_agent") == "assistant"
    finals = stats.select(
        "trajectory_id",
        F.when(verified, F.col("last_output")).otherwise(F.lit("")).alias("repaired_code"),
        repair_reasoning_text(F.col("first_agent"), F.lit("Logic"), F.concat(F.lit("rewrite after "),
                              F.col("num_steps").cast("string"), F.lit(" steps")), verified).alias("repair_reasoning"),
        verified.alias("verified"))
    first = steps.groupBy("trajectory_id").agg(F.min_by("output", "seq").alias("task"))
    ctx = first.select("trajectory_id", "task", F.lit("").alias("plan"), F.col("task").alias("failed_code"),
                       F.when(F.length("task") % 2 == 0, F.lit("Logic")).otherwise(F.lit("logic")).alias("failure_cluster"),
                       F.col("trajectory_id").alias("source_task_id"))
    ex = tr.to_training_examples(finals, ctx)
    return ex.select(tr.deterministic_id("trajectory_id").alias("example_id"), "trajectory_id", "failure_cluster",
                     "repair_reasoning", F.length("repaired_code").cast("bigint").alias("repaired_chars"), "verified")


# --- reports: K8-K11, J7, W4, A10, A11, P29, F7, T6, U2 ---------------------------------------
@query("round_metrics")
def round_metrics_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.operators import reports
    m = fixtures.round_metrics(spark, sf_dir)
    return reports.report_rows(m).select("run_name", "round", "metric", r6("value").alias("value"), "cell")


@query("round_log")
def round_log_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-or-replace of whole rounds: the English run is re-evaluated and logged again."""
    from failurelens.operators import reports
    first = fixtures.round_metrics(spark, sf_dir).withColumn("logged_at", F.lit(1))
    again = (fixtures.round_metrics(spark, sf_dir).where(F.col("run_name") == "en")
             .where(F.col("metric") == "labels/pass@1")
             .select("run_name", "round", F.lit("relogged/pass@1").alias("metric"), "value", "integral")
             .withColumn("logged_at", F.lit(2)))
    log = reports.log_round(first, again)
    return log.select("run_name", "round", "metric", r6("value").alias("value"), "logged_at")


@query("run_comparison")
def run_comparison_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.operators import reports
    return reports.compare_runs(fixtures.run_metrics(spark, sf_dir))


@query("round_deltas")
def round_deltas_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.operators import reports
    d = reports.round_deltas(fixtures.round_metrics(spark, sf_dir), ["labels/pass@1", "toxic/pass@1"])
    return d.select("run_name", "round", "metric", r6("value").alias("value"), r6("delta").alias("delta"))


@query("experiment_summary")
def experiment_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.operators import reports
    return reports.experiment_summary(fixtures.round_metrics(spark, sf_dir))


@query("step_totals")
def step_totals_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.operators import reports
    res = parse_exec_log(fixtures.exec_log(spark, sf_dir))
    repaired = res.withColumns({"expert_called": ~F.col("success"), "repair_verified": F.col("error_type") == "AssertionError"})
    t = reports.step_totals(repaired, ["benchmark"])
    return t.select("benchmark", "tests_passed", "tests_failed", "tests_total",
                    r6("avg_execution_time_ms").alias("avg_execution_time_ms"), "task_success", "executions",
                    "experts_called", "repairs_verified")


# --- responses: P14-P19 -----------------------------------------------------------------
@query("json_responses")
def json_responses_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.functions import responses as rs
    r = rs.with_parsed(fixtures.json_responses(spark, sf_dir), "response", "_v")
    p = r.select("event_id", "response", F.col("_v").isNotNull().alias("parsed"),
                 rs.planner_output("response", "_v").alias("plan"), rs.critic_output("response", "_v").alias("critic"))
    from failurelens.functions.text import plan_text
    return p.select("event_id", "parsed",
                    plan_text("plan.algorithm_strategy", "plan.complexity_estimate", "plan.edge_cases",
                              "plan.key_observations").alias("plan_text"),
                    F.col("plan.algorithm_strategy").alias("algorithm_strategy"),
                    F.col("plan.complexity_estimate").alias("complexity_estimate"),
                    F.array_join("plan.edge_cases", ", ").alias("edge_cases"),
                    F.col("plan.key_observations").alias("key_observations"),
                    F.col("critic.is_valid").alias("is_valid"),
                    r6("critic.confidence").alias("confidence"),
                    F.array_join("critic.issues_found", "; ").alias("issues_found"))


@query("code_blocks")
def code_blocks_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.functions import responses as rs
    r = rs.with_parsed(fixtures.code_responses(spark, sf_dir), "response", "_v")
    d = rs.debugger_output("response", "_v")
    return r.select("doc_id", rs.coder_output("response").alias("code"),
                    d["analysis"]["root_cause"].alias("debug_root_cause"),
                    F.length(d["analysis"]["detailed_explanation"]).cast("bigint").alias("debug_explanation_chars"))


# --- problems: S1-S3, T4, P10-P12 ---------------------------------------------------------
@query("problems")
def problems_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.functions import execlog as ex
    from failurelens.functions.text import fingerprint
    p = fixtures.problems(spark, sf_dir)
    cases = F.array(F.struct(F.col("test").alias("test_code")))
    return p.select(
        "ordinal", "task_id", "entry_point",
        F.length("prompt").cast("bigint").alias("prompt_chars"),
        ex.test_code_from_cases(cases).alias("test_code"),
        ex.mbpp_script(F.concat(F.lit("def "), F.col("entry_point"), F.lit("(x):\n    return x")), "test_list")
        .alias("mbpp_script"),
        fingerprint(ex.wrapped_script(F.col("prompt"), F.col("test"), F.col("entry_point"))).alias("wrapped_fp"),
        fingerprint(ex.benchmark_script(F.col("prompt"), F.col("test"), F.col("entry_point"))).alias("benchmark_fp"),
    )


# --- prompt requests: P22, E1 ----------------------------------------------------------
@query("prompt_requests")
def prompt_requests_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.functions.prompts import CODER, PLANNER, request_table
    p = fixtures.problems(spark, sf_dir)
    plan = F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("Strategy: loop over "), F.col("entry_point")))
    reqs = request_table(p, PLANNER, "task_id", task="prompt").unionByName(
        request_table(p.withColumn("plan_text", plan), CODER, "task_id", task="prompt", plan="plan_text"))
    return reqs.select("request_id", "role", F.col("messages")[0]["content"].alias("system_prompt"),
                       F.col("messages")[1]["content"].alias("user_prompt"))


# --- fitting on whole tables: M9 fallback + M10 + W5, M9 Lloyd fit, M5-M7 ------------
@query("heuristic_init")
def heuristic_init_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means fit on the per-label mean vectors: 10 rows < min_samples, so the
    evenly spaced heuristic start applies."""
    from failurelens.operators import cluster
    c = cluster.fit(fixtures.label_mean_vectors(spark, sf_dir), None, k=6, min_samples=20, order_col="seq")
    return _explode_centroids(c.withColumn("n_assigned", F.lit(0)))


@query("kmeans_fit")
def kmeans_fit_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lloyd iterations from the anchored centroids to convergence (iterative: no SQL twin)."""
    from failurelens.operators import cluster
    v = fixtures.vectors(spark, sf_dir)
    c = cluster.fit(v, fixtures.label_anchor_centroids(spark, sf_dir), k=6, min_samples=20)
    a = cluster.assign(v, c)
    return cluster.cluster_stats(a).select("cluster_name", "total_failures", r6("failure_rate").alias("failure_rate"))


@query("failure_embedding")
def failure_embedding_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure texts -> md5 term encoder -> anchored centroids in the same space -> cluster."""
    from failurelens.functions import text as tx
    from failurelens.operators import cluster
    d = fixtures.failure_text_inputs(spark, sf_dir)
    texts = d.select("doc_id", tx.failure_text("task", tx.failing_code("repaired_code", "student_code"),
                                               "error_type", "stderr", "traceback").alias("failure_text"))
    emb = cluster.term_encoder(texts, "failure_text")
    anchors = cluster.anchored_centroids(spark, k=6, encoder=lambda d: cluster.term_encoder(d, "text"))
    a = cluster.assign(emb, anchors, "embedding")
    return a.select("doc_id", "cluster_name", r6("similarity").alias("similarity"))


# --- operators by themselves: J6, S1-S3 form, T4, F1, F3, F5, F6, J2, J5, J9, A10, U1-U3, K1, S8, T3, P17, P22 ------
@query("pass_at_k_fixed_n")
def pass_at_k_fixed_n_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user is a task with as many samples as the log has of any one (5 at least), whether recorded or not."""
    results = parse_exec_log(fixtures.exec_log(spark, sf_dir))
    tasks = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("task_id")).union(
        results.select("task_id"))
    most = results.groupBy("task_id").count().agg(F.max("count")).first()[0] or 0
    counts = evaluate.correct_counts(results, tasks=tasks, num_samples=max(most, 5))
    counts = counts.withColumn("benchmark", F.lit("Users"))
    return evaluate.benchmark_metrics(counts, ks=(1, 5)).select("benchmark", "metric", r6("value").alias("value"))


@query("expanded_samples")
def expanded_samples_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.problems(spark, sf_dir).select("task_id")
    return evaluate.expand_samples(p, 5).select("task_id", F.col("sample_id").cast("bigint").alias("sample_id"))


@query("first_problems")
def first_problems_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 problems in pipeline form."""
    from failurelens.sources import files
    p = files.pipeline_problems(fixtures.problems(spark, sf_dir), max_tasks=25)
    return p.select("ordinal", "task_id", "entry_point", F.col("test_cases")[0]["test_code"].alias("test_code"))


@query("benchmark_log")
def benchmark_log_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.sources import files
    log = fixtures.exec_log(spark, sf_dir)
    return files.enabled_benchmarks(log, ["HumanEval"]).groupBy("benchmark").agg(F.count(F.lit(1)).alias("n"))


@query("recent_logic_failures")
def recent_logic_failures_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    from failurelens.functions.text import iso_utc
    from failurelens.operators import store
    s = _store(spark, sf_dir, "failure_cluster", "created_at")
    return store.by_cluster(s, "Logic", 100).select("record_id", "failure_cluster", iso_utc("created_at").alias("created_at"))


@query("store_totals")
def store_totals_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by cluster, the whole store's rows, and its rows with an embedding."""
    from failurelens.operators import store
    s = _store(spark, sf_dir, "failure_cluster", "embedding")
    total = store.total_count(s).select(F.lit("all").alias("kind"), F.lit("").alias("name"), F.col("total").alias("n"))
    with_vector = store.all_embeddings(s).agg(F.count(F.lit(1)).alias("n")).select(F.lit("embedded"), F.lit(""), "n")
    return store.count_by_cluster(s).select(F.lit("cluster").alias("kind"), F.col("failure_cluster").alias("name"),
                                            F.col("cnt").alias("n")).union(total).union(with_vector)


@query("store_replaced")
def store_replaced_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of the later half of the log replace stored ones of the earlier half."""
    from failurelens.operators import store
    batch = fixtures.failure_batch(spark, sf_dir).select("record_id", "task", "failure_cluster", "created_at", "seq")
    first, later = batch.where("seq % 4 < 2"), batch.where("seq % 4 >= 2")
    return store.upsert(store.upsert(None, first), later).select("record_id", "failure_cluster", "seq")


@query("similar_to_one")
def similar_to_one_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to that of vec_id 7."""
    from failurelens.operators import store
    v = fixtures.vectors(spark, sf_dir)
    query_vector = v.where("vec_id = 7").select(F.col("embedding").cast("array<double>")).first()[0]
    near = store.search_similar(v, query_vector, 10, id_col="vec_id", vec_col="embedding")
    return near.select("vec_id", r6("similarity").alias("similarity"))


@query("execution_outcomes")
def execution_outcomes_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log split by success, with the code x test pairs of the failures' tasks."""
    from failurelens.operators import tasks
    ok, failed = tasks.split_by_success(parse_exec_log(fixtures.exec_log(spark, sf_dir)))
    return ok.select("task_id", "sample_id", F.lit("ok").alias("outcome")).unionByName(
        failed.select("task_id", "sample_id", F.lit("failed").alias("outcome")))


@query("code_test_pairs")
def code_test_pairs_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as codes and problems as tests, matched by position; the longer side's rest drops."""
    from failurelens.operators import tasks
    codes = fixtures.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.length("text").cast("bigint").alias("code_chars"))
    tests = fixtures.problems(spark, sf_dir).select("ordinal", "entry_point")
    return tasks.pair_code_and_tests(codes, tests, keys=["ordinal"])


@query("task_stages")
def task_stages_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each task: its latest execution and its latest example."""
    from failurelens.operators import tasks
    runs = parse_exec_log(fixtures.exec_log(spark, sf_dir)).select("task_id", F.col("sample_id").alias("attempt"), "passed", "success")
    examples = fixtures.training_examples(spark, sf_dir).select(F.col("source_task_id").alias("task_id"), F.col("seq").alias("attempt"), "failure_cluster")
    m = tasks.merge_stages({"run": runs, "example": examples})
    return m.select("task_id", "run_attempt", "run_passed", "run_success", "example_attempt", "example_failure_cluster")


@query("kept_examples")
def kept_examples_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of verified, non-empty repairs, and tasks that produced one."""
    from failurelens.operators import trajectories as tr
    ex = fixtures.training_examples(spark, sf_dir).withColumn("verified", F.col("seq") % 2 == 0) \
        .withColumn("repaired_code", F.when(F.col("seq") % 5 == 0, F.lit("")).otherwise(F.col("repaired_code")))
    kept = tr.quality_filter(ex, verified_only=True, non_empty_only=True)
    produced = tr.produced_example(ex.withColumn("training_example", F.when(F.col("seq") % 3 == 0, F.col("problem"))))
    return kept.select("seq", F.lit("kept").alias("list")).union(produced.select("seq", F.lit("produced")))


@query("metric_names")
def metric_names_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metric names of two tables, united."""
    from failurelens.operators import reports
    rounds = fixtures.round_metrics(spark, sf_dir).select("run_name", "metric", "value")
    return reports.metric_names(rounds.unionByName(fixtures.run_metrics(spark, sf_dir).select("run_name", "metric", "value")))


@query("merged_metrics")
def merged_metrics_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by run and name; those of the later table win."""
    runs = fixtures.run_metrics(spark, sf_dir).select("run_name", "metric", "value")
    again = runs.where(F.col("run_name") == "en").withColumn("value", F.col("value") + 1)
    m = evaluate.merge_metrics(runs, again, key_cols=("run_name", "metric"))
    return m.select("run_name", "metric", r6("value").alias("value"))


@query("buffer_append")
def buffer_append_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the examples appended to a buffer of the other half, the newest 700 kept."""
    from failurelens.operators import buffer
    ex = fixtures.training_examples(spark, sf_dir)
    held = buffer.append(ex.where("seq % 2 = 0"), ex.where("seq % 2 = 1"), capacity=700)
    return held.select("seq", "failure_cluster", "trajectory_id")


@query("debug_answers")
def debug_answers_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debugger answers that are JSON: the parsed branch."""
    from failurelens.functions import responses as rs
    e = fixtures.table(spark, sf_dir, "events")
    answer = F.concat(F.lit('{"root_cause": "'), F.col("event_type"), F.lit('", "detailed_explanation": "seen by '),
                      F.col("user_id").cast("string"), F.lit('"}'))
    r = rs.with_parsed(e.select("event_id", answer.alias("response")), "response", "_v")
    d = rs.debugger_output("response", "_v")
    return r.select("event_id", d["analysis"]["root_cause"].alias("root_cause"),
                    d["analysis"]["detailed_explanation"].alias("explanation"))


@query("repair_requests")
def repair_requests_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the debugger's and the critic's requests."""
    from failurelens.functions import prompts as pr
    from failurelens.functions.text import fingerprint
    d = fixtures.failure_text_inputs(spark, sf_dir).withColumn("id", F.col("doc_id").cast("string"))
    out = None
    for role in (pr.DEBUGGER, pr.CRITIC):
        reqs = pr.request_table(d, role, "id", **{slot: "task" for slot in pr.slots(role)})
        part = reqs.select("request_id", "role", fingerprint(F.col("messages")[1]["content"]).alias("user_fp"))
        out = part if out is None else out.unionByName(part)
    return out


@query("run_flags")
def run_flags_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preset runs' flags beside the metric rows of runs of their names."""
    from failurelens.operators import routing
    flags = routing.ablation_flags(spark)
    m = fixtures.run_metrics(spark, sf_dir).withColumn(
        "run_name", F.concat(F.lit("run"), (F.length("metric") % 6).cast("string"))).select("run_name", "metric", "value")
    return m.join(F.broadcast(flags), "run_name", "left").select(
        "run_name", "metric", r6("value").alias("value"), "use_agentic_repair", "use_distillation")


# --- files by byte range: S4, S9, S11, K4, K7, W2 -----------------------------------------------------------------
def _scratch(spark: SparkSession, name: str) -> str:
    from uuid import uuid4

    from failurelens.session import scratch_path
    return scratch_path(spark, f"{name}-{uuid4().hex}")


@query("buffer_file")
def buffer_file_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buffer written as JSON lines without numbers and read back: the last 700 lines are the newest rows."""
    from failurelens.operators import buffer
    from failurelens.sources import files
    path = _scratch(spark, "buffer-file")
    ex = fixtures.training_examples(spark, sf_dir).repartitionByRange(8, "seq").sortWithinPartitions("seq")
    ex.drop("seq").write.option("ignoreNullFields", "false").json(path)
    held = buffer.fifo(files.buffer_lines(spark, path), 700)
    return held.select("failure_cluster", "trajectory_id", "problem", "plan")


@query("event_file")
def event_file_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log of all executions and plans, written and read back with typed fields."""
    from failurelens.streaming import streams
    path = _scratch(spark, "event-file")
    runs = parse_exec_log(fixtures.exec_log(spark, sf_dir)).withColumn("attempt", F.col("sample_id"))
    streams.log_events(streams.stage_events(runs, "execution_completed"), path)
    plans = fixtures.training_examples(spark, sf_dir).select(
        F.col("source_task_id").alias("task_id"), F.length("plan").alias("plan_len"))
    streams.log_events(streams.stage_events(plans, "planner_executed"), path)
    field = lambda name, kind: F.try_variant_get("payload", f"$.{name}", kind).alias(name)
    return streams.event_lines(spark, path).where("timestamp is not null").select(
        "event", "task_id", field("success", "boolean"), field("attempt", "bigint"), field("passed", "bigint"),
        field("total", "bigint"), field("plan_len", "bigint"))


@query("tracker_file")
def tracker_file_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tracker document of all runs' rounds, written and read back whole."""
    from failurelens.sources import files
    path = _scratch(spark, "tracker-file")
    rounds = fixtures.round_metrics(spark, sf_dir)
    files.write_tracker(rounds.select("round", F.concat_ws("/", "run_name", "metric").alias("metric"), "value"), path)
    return files.tracker_documents(spark, path).select("round", "metric", r6("value").alias("value"))


# --- bucketed store: K1, K2, S7 -------------------------------------------------------------------------------------
@query("store_replaced_bucketed")
def store_replaced_bucketed_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As store_replaced, with the earlier failures in buckets: only the later ones are shuffled."""
    from failurelens.operators import bucketed
    batch = fixtures.failure_batch(spark, sf_dir).select("record_id", "task", "failure_cluster", "created_at", "seq")
    path = _scratch(spark, "bucketed-store")
    name = "store_" + path.rsplit("-", 1)[1]
    bucketed.upsert(spark, name, path, batch.where("seq % 4 < 2"), 1, buckets=16)
    rows = bucketed.upsert(spark, name, path, batch.where("seq % 4 >= 2"), 2, buckets=16)
    return rows.select("record_id", "failure_cluster", "seq")


# --- samples from a mergeable summary: M1, M2, M3 -------------------------------------------------------------------
@query("sample_summary")
def sample_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts of the buffer summarised apart and merged, then drawn from for the store's rates, for none, and uniformly."""
    from failurelens.operators import sampling
    rows = _buffer(spark, sf_dir).select("seq", "failure_cluster")
    held = None
    for part in range(3):
        held = sampling.merge(held, sampling.summarise(rows.where(F.col("seq") % 3 == part), SAMPLE_N), SAMPLE_N)
    path = _scratch(spark, "sample-summary")
    held.write.parquet(path)
    held = spark.read.schema(held.schema).parquet(path)
    drawn = None
    for name, rates in (("store", _store_rates(spark, sf_dir)), ("none", None)):
        s = sampling.draw_weighted(held, SAMPLE_N, rates).select(
            F.lit(name).alias("rates"), "seq", "failure_cluster", r6("raw_weight").alias("raw_weight"))
        drawn = s if drawn is None else drawn.unionByName(s)
    even = sampling.draw_uniform(held, SAMPLE_N)
    return drawn.unionByName(even.select(F.lit("uniform").alias("rates"), "seq", "failure_cluster", F.lit(1.0).alias("raw_weight")))
