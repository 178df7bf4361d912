"""Repair trajectories: steps -> documents, counts, training examples.

Steps are rows ``(trajectory_id, seq, agent, action, reasoning, output)``.
Counting work (steps, attempts, first/last step) is a partial aggregate per
trajectory; the nested document form (``steps ARRAY<STRUCT>``) is built only
when a caller asks for documents to write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failurelens.functions.text import canonical_cluster
from failurelens.schemas import REPAIR_TRAJECTORY, TRAINING_EXAMPLE

COUNTED_ACTION = "generate_repair"


def deterministic_id(*cols) -> Column:
    """uuid-shaped id from SHA-256 of the key columns: stable under task retries
    (a random uuid would change when a lost partition is recomputed)."""
    h = F.sha2(F.concat_ws("|", *[F.col(c) if isinstance(c, str) else c for c in cols]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def trajectory_stats(steps: DataFrame, counted_action: str = COUNTED_ACTION) -> DataFrame:
    """Per trajectory: step count, attempt count (steps with ``counted_action``),
    first agent, last agent/output. One hash aggregate with map-side combine."""
    return steps.groupBy("trajectory_id").agg(
        F.count(F.lit(1)).alias("num_steps"),
        F.count_if(F.col("action") == counted_action).cast("int").alias("num_attempts"),
        F.min_by("agent", "seq").alias("first_agent"),
        F.max_by("agent", "seq").alias("last_agent"),
        F.max_by("output", "seq").alias("last_output"),
    )


def assemble(steps: DataFrame, finals: DataFrame | None = None,
             counted_action: str = COUNTED_ACTION) -> DataFrame:
    """Nested trajectory documents (for writing JSON / feeding the store).

    Each document holds its own steps, so one trajectory's steps meet in one
    task by definition; the rows are bounded by the trajectory's length.
    ``finals`` supplies (trajectory_id, repaired_code, repair_reasoning, verified).
    """
    docs = steps.groupBy("trajectory_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "agent", "action", "reasoning", "output"))).alias("_s"),
        F.count_if(F.col("action") == counted_action).cast("int").alias("num_attempts"),
    ).select("trajectory_id",
             F.transform("_s", lambda s: F.struct(s["agent"].alias("agent"), s["action"].alias("action"),
                                                  s["reasoning"].alias("reasoning"),
                                                  s["output"].alias("output"))).alias("steps"),
             "num_attempts")
    if finals is None:
        finals = steps.sparkSession.createDataFrame(
            [], "trajectory_id string, repaired_code string, repair_reasoning string, verified boolean")
    j = docs.join(finals, on="trajectory_id", how="left")
    return j.select("trajectory_id", "steps",
                    F.coalesce("repair_reasoning", F.lit("")).alias("repair_reasoning"),
                    F.coalesce("repaired_code", F.lit("")).alias("repaired_code"),
                    F.coalesce("verified", F.lit(False)).alias("verified"),
                    "num_attempts")


def finalise(df: DataFrame, repaired_code, repair_reasoning, verified) -> DataFrame:
    """Set the final repair fields on trajectory rows."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return df.withColumns({"repaired_code": c(repaired_code), "repair_reasoning": c(repair_reasoning),
                           "verified": F.coalesce(c(verified), F.lit(False))})


def to_training_examples(trajectories: DataFrame, context: DataFrame, key: str = "trajectory_id") -> DataFrame:
    """Trajectory + task context -> training examples.

    ``context``: (key, task, plan, failed_code, failure_cluster, source_task_id).
    A context row without a trajectory still yields an example with empty
    repair fields; the cluster label is parsed strictly.
    """
    t = trajectories.select(key, "repair_reasoning", "repaired_code", "verified")
    j = context.join(t, on=key, how="left")
    return j.select(
        F.col("task").alias("problem"),
        F.coalesce(F.col("plan"), F.lit("")).alias("plan"),
        F.col("failed_code"),
        F.coalesce(F.col("repair_reasoning"), F.lit("")).alias("repair_reasoning"),
        F.coalesce(F.col("repaired_code"), F.lit("")).alias("repaired_code"),
        canonical_cluster(F.coalesce(F.col("failure_cluster"), F.lit("Unknown")), "strict").alias("failure_cluster"),
        F.lit(1.0).alias("weight"),
        F.col(key).alias("trajectory_id"),
        F.col("source_task_id").cast("string"),
        F.coalesce(F.col("verified"), F.lit(False)).alias("verified"),
    )


def quality_filter(examples: DataFrame, verified_only: bool = False, non_empty_only: bool = False) -> DataFrame:
    """Optional filters on distilled examples (all rows kept by default)."""
    out = examples
    if verified_only and "verified" in examples.columns:
        out = out.where(F.col("verified"))
    if non_empty_only:
        out = out.where(F.coalesce(F.col("repaired_code"), F.lit("")) != "")
    return out


def produced_example(tasks: DataFrame, col: str = "training_example") -> DataFrame:
    """Tasks that produced a training example."""
    return tasks.where(F.col(col).isNotNull())


# --- persistence ------------------------------------------------------------
def save(trajectories: DataFrame, path: str, mode: str = "append") -> None:
    """Write trajectory documents as JSON lines (null fields kept)."""
    trajectories.write.mode(mode).option("ignoreNullFields", "false").json(path)


def load(spark: SparkSession, path: str, documents: bool = False) -> DataFrame:
    """Trajectories from JSON lines, or with ``documents`` from files of one (indented) document
    each. A file of the other form is an error, not null rows."""
    return spark.read.schema(REPAIR_TRAJECTORY).option("multiLine", documents).option("mode", "FAILFAST").json(path)


def load_one(spark: SparkSession, path: str, trajectory_id: str, documents: bool = False) -> DataFrame:
    return load(spark, path, documents).where(F.col("trajectory_id") == trajectory_id)


def list_ids(spark: SparkSession, path: str, documents: bool = False) -> DataFrame:
    return load(spark, path, documents).select("trajectory_id").distinct()


def save_examples(examples: DataFrame, path: str, mode: str = "overwrite") -> None:
    cols = [f.name for f in TRAINING_EXAMPLE.fields if f.name in examples.columns]
    examples.select(*cols).write.mode(mode).option("ignoreNullFields", "false").json(path)
