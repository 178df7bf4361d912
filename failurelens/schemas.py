"""Explicit schemas for every record the library reads or writes.

Nothing is inferred: readers pass these to ``spark.read.schema(...)``.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------
# Failure cluster domain, in declaration order. The first six are clusters;
# "Unknown" is the fallback label.
CLUSTER_NAMES = ["Syntax", "Runtime", "Logic", "EdgeCases", "AlgorithmDesign", "Efficiency"]
UNKNOWN_CLUSTER = "Unknown"
ALL_LABELS = CLUSTER_NAMES + [UNKNOWN_CLUSTER]

# Error names detected in stderr, in priority order (first listed match wins).
ERROR_TYPES = [
    "SyntaxError",
    "IndentationError",
    "NameError",
    "TypeError",
    "ValueError",
    "IndexError",
    "KeyError",
    "AttributeError",
    "ZeroDivisionError",
    "RecursionError",
    "MemoryError",
    "TimeoutError",
    "RuntimeError",
    "AssertionError",
    "ImportError",
]

# Stage labels produced by the routing functions.
STAGE_SUCCESS_STORE = "success_store"
STAGE_FAILURE_ANALYSIS = "failure_analysis"
STAGE_RE_EXECUTE = "re_execute"
STAGE_EXPERT_REPAIR = "expert_repair"
STAGE_DISTILLATION = "distillation"

# Ablation presets: run -> (use_agentic_repair, use_distillation,
# use_failure_clustering, use_adaptive_curriculum)
ABLATION_RUNS = [
    ("run0", False, False, False, False),
    ("run1", True, False, False, False),
    ("run2", True, True, False, False),
    ("run3", False, True, True, True),
    ("run4", True, True, True, True),
]

# ---------------------------------------------------------------------------
# Record schemas
# ---------------------------------------------------------------------------
EXEC_LOG = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("sample_id", T.LongType()),
    T.StructField("stdout", T.StringType()),
    T.StructField("stderr", T.StringType()),
    T.StructField("returncode", T.IntegerType()),
    T.StructField("timed_out", T.BooleanType()),
    T.StructField("elapsed_ms", T.DoubleType()),
])

EXECUTION_RESULT = T.StructType([
    T.StructField("passed", T.LongType()),
    T.StructField("failed", T.LongType()),
    T.StructField("total", T.LongType()),
    T.StructField("stderr", T.StringType()),
    T.StructField("stdout", T.StringType()),
    T.StructField("returncode", T.IntegerType()),
    T.StructField("timeout", T.BooleanType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("traceback", T.StringType()),
    T.StructField("execution_time_ms", T.DoubleType()),
])

REPAIR_STEP = T.StructType([
    T.StructField("agent", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("output", T.StringType()),
])

REPAIR_TRAJECTORY = T.StructType([
    T.StructField("trajectory_id", T.StringType()),
    T.StructField("steps", T.ArrayType(REPAIR_STEP)),
    T.StructField("repair_reasoning", T.StringType()),
    T.StructField("repaired_code", T.StringType()),
    T.StructField("verified", T.BooleanType()),
    T.StructField("num_attempts", T.IntegerType()),
])

FAILURE_RECORD = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("traceback", T.StringType()),
    T.StructField("failure_cluster", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("repair_trace", REPAIR_TRAJECTORY),
    T.StructField("created_at", T.TimestampType()),
])

TRAINING_EXAMPLE = T.StructType([
    T.StructField("problem", T.StringType()),
    T.StructField("plan", T.StringType()),
    T.StructField("failed_code", T.StringType()),
    T.StructField("repair_reasoning", T.StringType()),
    T.StructField("repaired_code", T.StringType()),
    T.StructField("failure_cluster", T.StringType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("trajectory_id", T.StringType()),
    T.StructField("source_task_id", T.StringType()),
])

# Buffer rows carry an explicit arrival sequence.
BUFFER_ROW = T.StructType([T.StructField("seq", T.LongType())] + TRAINING_EXAMPLE.fields)

PLAN_OUTPUT = T.StructType([
    T.StructField("algorithm_strategy", T.StringType()),
    T.StructField("complexity_estimate", T.StringType()),
    T.StructField("edge_cases", T.ArrayType(T.StringType())),
    T.StructField("key_observations", T.StringType()),
])

FAILURE_ANALYSIS = T.StructType([
    T.StructField("root_cause", T.StringType()),
    T.StructField("error_category", T.StringType()),
    T.StructField("detailed_explanation", T.StringType()),
    T.StructField("suggested_fix_strategy", T.StringType()),
    T.StructField("relevant_code_section", T.StringType()),
])

CRITIC_VERDICT = T.StructType([
    T.StructField("is_valid", T.BooleanType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("issues_found", T.ArrayType(T.StringType())),
    T.StructField("reasoning", T.StringType()),
    T.StructField("suggested_improvements", T.StringType()),
])

CHAT_MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])
CHAT_EXAMPLE = T.StructType([T.StructField("messages", T.ArrayType(CHAT_MESSAGE))])

HUMANEVAL_PROBLEM = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("entry_point", T.StringType()),
    T.StructField("test", T.StringType()),
    T.StructField("canonical_solution", T.StringType()),
])

MBPP_PROBLEM_RAW = T.StructType([
    T.StructField("task_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("test_list", T.ArrayType(T.StringType())),
    T.StructField("test_setup_code", T.StringType()),
])

METRIC_ROW = T.StructType([
    T.StructField("run_name", T.StringType()),
    T.StructField("round", T.IntegerType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

EVENT = T.StructType([
    T.StructField("event", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("data", T.MapType(T.StringType(), T.StringType())),
])

CENTROIDS = T.StructType([
    T.StructField("cluster_idx", T.IntegerType()),
    T.StructField("cluster_name", T.StringType()),
    T.StructField("centroid", T.ArrayType(T.DoubleType())),
])
