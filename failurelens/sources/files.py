"""File sources and sinks with explicit schemas (nothing inferred).

Problems (HumanEval / MBPP JSON lines, or Parquet), the replay buffer (JSON
lines), the experiment tracker document, chat datasets, metric logs and
reports. Writers keep null fields (Spark drops them by default) so files
round-trip with the same keys.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from failurelens.functions.text import iso_utc
from failurelens.operators.store import path_exists
from failurelens.schemas import BUFFER_ROW, HUMANEVAL_PROBLEM, MBPP_PROBLEM_RAW, METRIC_ROW
from failurelens.sources import lines

TRACKER = T.StructType([
    T.StructField("started_at", T.StringType()),
    T.StructField("completed_at", T.StringType()),
    T.StructField("config", T.MapType(T.StringType(), T.StringType())),
    T.StructField("rounds", T.ArrayType(T.StructType([
        T.StructField("round", T.IntegerType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("dataset_stats", T.MapType(T.StringType(), T.LongType())),
    ]))),
])


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str | None = None) -> DataFrame:
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "json")
    return spark.read.schema(schema).format(fmt).load(path)


def humaneval_problems(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """HumanEval-form problems: task_id, prompt, entry_point, test, canonical_solution."""
    return _read(spark, path, HUMANEVAL_PROBLEM, fmt)


def mbpp_problems(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """MBPP-form problems; task_id as text, missing setup code -> ''."""
    df = _read(spark, path, MBPP_PROBLEM_RAW, fmt)
    return df.select(F.col("task_id").cast("string").alias("task_id"), "text", "code", "test_list",
                     F.coalesce("test_setup_code", F.lit("")).alias("test_setup_code"))


def pipeline_problems(problems: DataFrame, max_tasks: int | None = None, ordinal_col: str = "ordinal") -> DataFrame:
    """Pipeline form: task_id, prompt, entry_point, test_cases[{test_code}]; first n by ordinal."""
    out = problems.select(
        *([ordinal_col] if ordinal_col in problems.columns else []),
        "task_id", "prompt", F.coalesce("entry_point", F.lit("")).alias("entry_point"),
        F.array(F.struct(F.coalesce("test", F.lit("")).alias("test_code"))).alias("test_cases"))
    if max_tasks is not None:
        order = ordinal_col if ordinal_col in out.columns else "task_id"
        out = out.orderBy(order).limit(max_tasks)
    return out


def enabled_benchmarks(df: DataFrame, enabled: list[str], col: str = "benchmark") -> DataFrame:
    return df.where(F.col(col).isin(*enabled))


# --- replay buffer ---------------------------------------------------------------
def read_buffer(spark: SparkSession, path: str) -> DataFrame:
    """Buffer JSON lines (blank lines are skipped by the reader). Rows without ``seq`` get
    the number of their line, files in order of name: arrival order is line order."""
    from failurelens.operators.buffer import arrival_numbers
    rows = arrival_numbers(spark.read.schema(BUFFER_ROW).json(path), "_line")
    return rows.withColumn("seq", F.coalesce("seq", "_line")).drop("_line")


def write_buffer(buffer: DataFrame, path: str) -> None:
    buffer.select(*[f.name for f in BUFFER_ROW.fields]).write.mode("overwrite") \
        .option("ignoreNullFields", "false").json(path)


def buffer_lines(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """Buffer JSON lines in one read: rows without ``seq`` get the place of their line, so arrival order is line order."""
    rows = positioned(spark, path, split).select(F.from_json("value", BUFFER_ROW).alias("r"), F.col("seq").alias("_place"))
    return rows.select(F.coalesce("r.seq", "_place").alias("seq"), *[f"r.{f.name}" for f in BUFFER_ROW.fields[1:]])


def positioned(spark: SparkSession, path: str, split: int | None = None, whole: bool = False) -> DataFrame:
    """Lines (or with ``whole`` files) with their places: (file, offset, seq, value)."""
    lines.register(spark)
    reader = spark.read.format("positioned_lines").option("whole", str(whole))
    return (reader.option("split", split) if split else reader).load(path)


# --- experiment tracker ----------------------------------------------------------------
def _tracker(spark: SparkSession, path: str) -> DataFrame:
    """The tracker document; none if there is no such file."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], TRACKER)
    return spark.read.schema(TRACKER).option("multiLine", True).json(path)


def read_tracker(spark: SparkSession, path: str) -> DataFrame:
    """Tracker document -> long metric rows ``(round, timestamp, metric, value)``."""
    rounds = _tracker(spark, path).select(F.explode("rounds").alias("r"))
    return rounds.select(F.col("r.round").alias("round"), F.col("r.timestamp").alias("timestamp"),
                         F.explode("r.metrics").alias("metric", "value"))


def tracker_documents(spark: SparkSession, path: str) -> DataFrame:
    """All tracker documents below ``path``, a file each, as rows ``(file, round, timestamp, metric, value)``."""
    rounds = positioned(spark, path, whole=True).select("file", F.explode(F.from_json("value", TRACKER)["rounds"]).alias("r"))
    return rounds.select("file", F.col("r.round").alias("round"), F.col("r.timestamp").alias("timestamp"),
                         F.explode("r.metrics").alias("metric", "value"))


def read_tracker_stats(spark: SparkSession, path: str) -> DataFrame:
    """Tracker document -> dataset statistics ``(round, name, n)``."""
    rounds = _tracker(spark, path).select(F.explode("rounds").alias("r"))
    return rounds.select(F.col("r.round").alias("round"), F.explode("r.dataset_stats").alias("name", "n"))


def read_tracker_config(spark: SparkSession, path: str) -> DataFrame:
    """Tracker document -> its configuration ``(key, value)``."""
    return _tracker(spark, path).select(F.explode("config").alias("key", "value"))


def write_tracker(rounds: DataFrame, path: str, started_at: str | None = None, config: dict[str, str] | None = None,
                  stats: DataFrame | None = None) -> None:
    """Long metric rows ``(round, metric, value)``, and dataset statistics ``(round, name, n)``, -> one tracker
    document, rounds sorted. It is one row: for the few rounds of an experiment."""
    per_round = rounds.groupBy("round").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("metrics"),
                                            iso_utc(F.current_timestamp()).alias("timestamp"))
    none = F.create_map().cast("map<string,bigint>")
    if stats is not None:
        named = stats.groupBy("round").agg(
            F.map_from_entries(F.collect_list(F.struct("name", F.col("n").cast("bigint")))).alias("dataset_stats"))
        per_round = per_round.join(named, "round", "left").withColumn("dataset_stats", F.coalesce("dataset_stats", none))
    else:
        per_round = per_round.withColumn("dataset_stats", none)
    by_round = lambda a, b: F.when(a["round"] < b["round"], -1).when(a["round"] > b["round"], 1).otherwise(0)
    held = F.create_map(*[F.lit(x) for kv in (config or {}).items() for x in kv]).cast("map<string,string>")
    doc = per_round.agg(F.array_sort(F.collect_list(F.struct("round", "timestamp", "metrics", "dataset_stats")), by_round)
                        .alias("rounds")) \
        .select(F.lit(started_at).alias("started_at"), iso_utc(F.current_timestamp()).alias("completed_at"),
                held.alias("config"), "rounds")
    doc.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


# --- datasets, metrics, reports -----------------------------------------------------
def write_chat_jsonl(chat: DataFrame, path: str) -> None:
    """One ``{"messages": [...]}`` object per line, raw UTF-8."""
    chat.select("messages").write.mode("overwrite").json(path)


def write_chat_parquet(chat: DataFrame, path: str) -> None:
    chat.select("messages").write.mode("overwrite").parquet(path)


def append_metrics(metrics: DataFrame, path: str, step: int | None = None) -> None:
    """Append long metric rows (run_name, round, metric, value[, step]) to a Parquet log."""
    cols = [f.name for f in METRIC_ROW.fields]
    out = metrics.select(*[F.col(c).cast(METRIC_ROW[c].dataType) for c in cols])
    if step is not None:
        out = out.withColumn("step", F.lit(step))
    out.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """Per-run report documents: run, round, timestamp, metrics sorted by name with cells."""
    from failurelens.functions.text import metric_cell
    rows = metrics.groupBy("run_name", "round").agg(
        F.array_sort(F.collect_list(F.struct("metric", "value", metric_cell("value").alias("cell")))).alias("metrics"))
    rows.withColumn("timestamp", iso_utc(F.current_timestamp())).write.mode("overwrite") \
        .option("ignoreNullFields", "false").json(os.path.join(path))
