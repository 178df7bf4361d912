"""Library inputs derived from the provided tables.

The provided data is generic (events, documents, embeddings, conversations...);
these functions map it onto the library's record shapes with plain column
expressions, so every derived input grows with its table. The same derivations
are written in SQL in :mod:`failurelens.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failurelens.functions.execlog import parse_exec_log
from failurelens.schemas import CLUSTER_NAMES
from failurelens.sources.tables import table

# Fixed values of the derivation (mirrored in the oracle SQL).
DERIVED_ERROR_NAMES = ["SyntaxError", "NameError", "TypeError", "IndexError",
                       "ZeroDivisionError", "RecursionError", "ModuleNotFoundError", "KeyboardInterrupt"]
EVENT_TYPE_LABELS = {"click": "Syntax", "error": "Runtime", "view": "Logic",
                     "purchase": "EdgeCases", "signup": " efficiency "}
NL = "\n"


def _n_tests() -> Column:
    return (F.floor(F.col("value")) % 4 + 1).cast("bigint")


def exec_log(spark: SparkSession, sf_dir: str, *carry: str) -> DataFrame:
    """events -> raw run log: task = user, sample = event; every parse branch occurs.

    purchase: clean pass; click: assertion failure; view: no RESULTS line;
    error: crash with traceback (return code 1); signup: timeout (even ids) or a
    malformed RESULTS line (odd ids). ``carry`` names event columns to keep.
    """
    e = table(spark, sf_dir, "events")
    n = _n_tests()
    et = F.col("event_type")
    odd = (F.col("event_id") % 2) == 1
    errname = F.element_at(F.array(*[F.lit(x) for x in DERIVED_ERROR_NAMES]), (F.col("event_id") % 8 + 1).cast("int"))
    stdout = (
        F.when(et == "purchase", F.concat(F.lit("running tests" + NL + "RESULTS: passed="), n.cast("string"),
                                          F.lit(" failed=0 total="), n.cast("string")))
        .when(et == "click", F.concat(F.lit("RESULTS: passed="), (n - 1).cast("string"),
                                      F.lit(" failed=1 total="), n.cast("string")))
        .when(et == "view", F.lit("no summary line" + NL + "done"))
        .when((et == "signup") & odd, F.concat(F.lit("RESULTS: passed="), n.cast("string"),
                                               F.lit(" failed=x total="), n.cast("string")))
        .otherwise(F.lit(""))
    )
    stderr = (
        F.when(et == "click", F.lit("FAIL: assertion failed" + NL + "AssertionError" + NL))
        .when(et == "error", F.concat(
            F.lit("Traceback (most recent call last):" + NL + '  File "solution.py", line '), n.cast("string"),
            F.lit(NL), errname, F.lit(": failed on input "), F.col("props"),
            F.when(F.col("event_id") % 3 == 0, F.lit(NL + "while handling ValueError")).otherwise(F.lit(""))))
        .otherwise(F.lit(""))
    )
    rc = F.when(et == "error", F.lit(1)).when((et == "signup") & ~odd, F.lit(-9)).otherwise(F.lit(0))
    return e.select(
        F.col("user_id").cast("string").alias("task_id"),
        F.col("event_id").alias("sample_id"),
        stdout.alias("stdout"),
        stderr.alias("stderr"),
        rc.cast("int").alias("returncode"),
        ((et == "signup") & ~odd).alias("timed_out"),
        (F.col("value") * 10).alias("elapsed_ms"),
        F.when(F.col("user_id") % 2 == 0, F.lit("HumanEval")).otherwise(F.lit("MBPP")).alias("benchmark"),
        *carry,
    )


def cluster_name_of(idx: Column) -> Column:
    """Cluster name for a 0-based index into the fixed cluster list."""
    return F.element_at(F.array(*[F.lit(x) for x in CLUSTER_NAMES]), (idx + 1).cast("int"))


def failure_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed executions -> failure records to upsert, in arrival order ``seq``.

    The key is (user, day): later failures of the same user on the same day
    replace earlier ones, which exercises latest-wins upserts on real data.
    """
    e = parse_exec_log(exec_log(spark, sf_dir, "event_id", "user_id", "ts", "value", "props")).where(~F.col("success"))
    return e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("record_id"),
        F.concat(F.lit("task "), F.col("user_id").cast("string")).alias("task"),
        F.concat(F.lit("def solve(x):" + NL + "    return x * "), F.format_string("%.2f", F.col("value"))).alias("code"),
        F.concat(F.lit("Traceback (most recent call last):" + NL + "Error "), F.col("props")).alias("traceback"),
        cluster_name_of(F.col("event_id") % 6).alias("failure_cluster"),
        F.col("event_id").alias("vec_key"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("seq"),
    )


def failure_batch_with_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """failure_batch plus an embedding: vector ``event_id mod (#vectors)`` of ``embeddings``."""
    emb = table(spark, sf_dir, "embeddings")
    n_vec = emb.select(F.count(F.lit(1))).scalar()
    fb = failure_batch(spark, sf_dir).withColumn("_vid", F.pmod(F.col("vec_key"), n_vec))
    return (fb.join(emb.select(F.col("vec_id").alias("_vid"), "embedding"), on="_vid", how="left")
            .drop("_vid", "vec_key"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> (seq, vec_id, label, embedding); arrival order = vec_id."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("seq"), "vec_id", "label", "embedding")


def label_anchor_centroids(spark: SparkSession, sf_dir: str, k: int = 6) -> DataFrame:
    """Anchored start centroids from data: cluster j = unit mean of the unit
    vectors whose ``label mod k == j`` (one partial aggregate, k rows out). Rows
    without a label or a vector belong to no cluster."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from failurelens.functions.vectors import l2_normalize
    from failurelens.operators.cluster import whole_vector
    v = vectors(spark, sf_dir).where(F.col("label").isNotNull() & whole_vector(F.col("embedding")))
    g = (v.select((F.col("label") % k).cast("int").alias("cluster_idx"),
                  array_to_vector(l2_normalize("embedding")).alias("_u"))
         .groupBy("cluster_idx").agg(Summarizer.mean(F.col("_u")).alias("_m")))
    return g.select("cluster_idx", cluster_name_of(F.col("cluster_idx")).alias("cluster_name"),
                    l2_normalize(vector_to_array("_m")).alias("centroid"))


def label_query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the component-wise mean embedding."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = vectors(spark, sf_dir)
    g = (v.select("label", array_to_vector(F.col("embedding").cast("array<double>")).alias("_x"))
         .groupBy("label").agg(Summarizer.mean(F.col("_x")).alias("_m")))
    return g.select(F.col("label").cast("bigint").alias("query_id"), vector_to_array("_m").alias("query_vec"))


def failure_text_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> (task, student/repaired code, error type, stderr, traceback) per doc."""
    d = table(spark, sf_dir, "documents")
    r = F.col("doc_id") % 3
    return d.select(
        "doc_id",
        F.col("text").alias("task"),
        F.concat(F.lit("def solve():" + NL + "    return "), F.col("source")).alias("student_code"),
        F.when(r == 0, F.lit("")).when(r == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("def solve():" + NL + "    return '"), F.col("lang"), F.lit("'"))).alias("repaired_code"),
        F.when(F.col("lang") == "en", F.lit("TypeError")).when(F.col("lang") == "de", F.lit(None).cast("string"))
        .when(F.col("lang") == "fr", F.lit("")).otherwise(F.lit("ValueError")).alias("error_type"),
        F.when(F.col("n_chars") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("Error while reading "), F.col("text")))
        .alias("stderr"),
        F.when(F.col("lang").isin("en", "fr"), F.concat(F.lit("Traceback (most recent call last):" + NL), F.col("text")))
        .otherwise(F.lit("")).alias("traceback"),
        F.col("text"),
    )


def _event_label() -> Column:
    m = F.create_map(*[v for k, lab in EVENT_TYPE_LABELS.items() for v in (F.lit(k), F.lit(lab))])
    return F.try_element_at(m, F.col("event_type"))


def training_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> buffer rows: seq = event_id, cluster label from the event type (lenient parse)."""
    from failurelens.functions.text import canonical_cluster
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("Problem for user "), F.col("user_id").cast("string")).alias("problem"),
        F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("Use approach "), F.col("props")))
        .alias("plan"),
        F.concat(F.lit("def f(x):" + NL + "    return x + "), F.format_string("%.2f", F.col("value"))).alias("failed_code"),
        F.concat(F.lit("Root cause: "), F.col("event_type")).alias("repair_reasoning"),
        F.concat(F.lit("def f(x):" + NL + "    return x - "), F.format_string("%.2f", F.col("value"))).alias("repaired_code"),
        canonical_cluster(_event_label(), "lenient").alias("failure_cluster"),
        F.lit(1.0).alias("weight"),
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("trajectory_id"),
        F.col("user_id").cast("string").alias("source_task_id"),
    )


def trajectory_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations -> repair steps: trajectory = conversation, seq = turn, agent = role."""
    c = table(spark, sf_dir, "conversations")
    action = (F.when(F.col("role") == "assistant", F.lit("generate_repair"))
              .when(F.col("role") == "user", F.lit("analyse_failure")).otherwise(F.lit("set_context")))
    return c.select(F.col("conv_id").cast("string").alias("trajectory_id"), F.col("turn").alias("seq"),
                    F.col("role").alias("agent"), action.alias("action"),
                    F.col("text").alias("reasoning"), F.col("text").alias("output"))


def round_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels x documents -> long metric rows (run = language, round = source number)."""
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    j = lab.join(doc, on="doc_id", how="inner")
    g = j.groupBy(F.col("lang").alias("run_name"),
                  F.regexp_extract("source", "([0-9]+)", 1).cast("int").alias("round")).agg(
        F.avg("quality").alias("m_pass1"),
        F.avg("toxic").alias("m_toxic"),
        F.count(F.lit(1)).alias("m_n"),
        F.avg(F.when(F.col("toxic") == 1, F.col("quality"))).alias("m_pass1_toxic"),
    )
    from failurelens.operators.reports import to_long
    long = to_long(g, ["run_name", "round"], {"m_pass1": "labels/pass@1", "m_toxic": "labels/toxic_rate",
                                              "m_n": "labels/num_problems", "m_pass1_toxic": "toxic/pass@1"})
    return long.where(F.col("value").isNotNull())


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels x documents -> one metric set per run (language) over all rounds."""
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    j = lab.join(doc, on="doc_id", how="inner")
    g = j.groupBy(F.col("lang").alias("run_name")).agg(
        F.avg("quality").alias("m_pass1"), F.avg("toxic").alias("m_toxic"),
        F.count(F.lit(1)).alias("m_n"),
        F.avg(F.when(F.col("n_chars") > 20000, F.col("quality"))).alias("m_long"),
    )
    from failurelens.operators.reports import to_long
    long = to_long(g, ["run_name"], {"m_pass1": "labels/pass@1", "m_toxic": "labels/toxic_rate",
                                     "m_n": "labels/num_problems", "m_long": "long_docs/pass@1"})
    return long.where(F.col("value").isNotNull())


def json_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> model responses: JSON objects, fenced JSON, damaged JSON and lists."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    doc = F.concat(
        F.lit('{"algorithm_strategy": "'), F.col("event_type"),
        F.lit('", "complexity_estimate": "O(n^'), (k % 3 + 1).cast("string"),
        F.lit(')", "edge_cases": ["user '), F.col("user_id").cast("string"), F.lit('", "empty"], "key_observations": "k='),
        k.cast("string"), F.lit('", "is_valid": '), F.when(k % 2 == 0, F.lit("true")).otherwise(F.lit("false")),
        F.lit(', "confidence": 0.'), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("}"))
    r = F.col("event_id") % 3
    resp = (F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("["), k.cast("string"), F.lit("]")))
            .when(r == 0, F.concat(doc, F.lit(" trailing words")))
            .when(r == 1, F.concat(F.lit("Here you go:" + NL + "```json" + NL), doc, F.lit(NL + "```")))
            .otherwise(doc))
    return e.select("event_id", resp.alias("response"))


def code_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> coder responses: fenced, plain, unclosed fence, empty first block."""
    d = table(spark, sf_dir, "documents")
    r = F.col("doc_id") % 4
    resp = (F.when(r == 0, F.concat(F.lit("Here is the fix:" + NL + "```python" + NL), F.col("text"),
                                    F.lit(NL + "```" + NL + "Hope it helps.")))
            .when(r == 1, F.col("text"))
            .when(r == 2, F.concat(F.lit("```" + NL), F.col("text")))
            .otherwise(F.concat(F.lit("  ```" + NL + "```" + NL), F.col("text"))))
    return d.select("doc_id", resp.alias("response"))


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark -> problem table (ordinal = item_id)."""
    b = table(spark, sf_dir, "benchmark")
    iid = F.col("item_id").cast("string")
    return b.select(
        F.col("item_id").alias("ordinal"),
        F.concat(F.lit("Bench/"), iid).alias("task_id"),
        F.col("text").alias("prompt"),
        F.concat(F.lit("solve_"), iid).alias("entry_point"),
        F.concat(F.lit("def check(candidate):" + NL + "    assert candidate("), iid, F.lit(") is not None")).alias("test"),
        F.array(F.concat(F.lit("assert solve_"), iid, F.lit("(1) == 1")),
                F.concat(F.lit("assert solve_"), iid, F.lit("(2) == 2"))).alias("test_list"),
    )


def label_mean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per label: (seq = label, embedding = mean vector), a small set derived from the table."""
    q = label_query_vectors(spark, sf_dir)
    return q.select(F.col("query_id").alias("seq"), F.col("query_vec").alias("embedding"))
