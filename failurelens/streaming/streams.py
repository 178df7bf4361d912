"""Structured Streaming versions of the incremental operators.

* event log: JSON lines in, typed rows out (``readStream``; ``availableNow``)
* running failure counts per cluster (stateful aggregate, complete mode)
* online failure clustering (``foreachBatch``): assign against the centroids of
  the previous batch, append the batch to the failure store, move centroids
  with the mini-batch EMA, write centroid version ``batch_id + 1``
* incremental replay buffer (``foreachBatch``): append + capacity

Every output of batch N is named by N and written from the state of N-1, so a
micro-batch replayed after a failure rewrites exactly its own output. A stream's
checkpoint is found by its name under ``spark.checkpoint.dir``, and an output folder
belongs to one checkpoint: a stream started from another one is refused.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from failurelens.functions.text import iso_utc
from failurelens.operators import buffer as buf
from failurelens.operators import cluster, sampling
from failurelens.operators.store import claim, read_state, write_batch, write_state
from failurelens.schemas import CENTROIDS
from failurelens.session import shared_folder
from failurelens.sources import files, lines

# ---------------------------------------------------------------------------
# Event log (one JSON object per line: event, timestamp, free-form keys)
# ---------------------------------------------------------------------------
def event_rows(df: DataFrame, event_name: str, task_col: str | None = "task_id", **fields) -> DataFrame:
    """Rows for the event log: event name, UTC timestamp, task id and the given
    fields, which keep their types (numbers and flags stay numbers and flags)."""
    data = F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]) if fields \
        else F.struct(F.lit(None).cast("string").alias("_none"))
    return df.select(F.lit(event_name).alias("event"), iso_utc(F.current_timestamp()).alias("timestamp"),
                     (F.col(task_col).cast("string") if task_col else F.lit("")).alias("task_id"),
                     data.alias("data"))


def log_events(rows: DataFrame, path: str) -> None:
    """Append event rows as JSON lines (one object per event, extra keys beside the common ones)."""
    flat = rows.select(F.to_json(F.struct("event", "timestamp", "task_id", "data.*"),
                                 {"ignoreNullFields": "true"}).alias("value"))
    flat.write.mode("append").text(path)


# Event names and fields, with their types
STAGE_EVENTS = {
    "planner_executed": "plan_len bigint",
    "student_generator_executed": "trajectory_id string, code_len bigint",
    "execution_completed": "success boolean, attempt bigint, passed bigint, total bigint",
    "failure_analysed": "error_type string",
    "failure_embedded": "description_len bigint",
    "failure_clustered": "cluster string",
    "expert_repair_completed": "trajectory_id string, verified boolean",
    "distillation_example_generated": "cluster string",
    "task_success_stored": "expert_called boolean",
}


def stage_events(df: DataFrame, stage: str, task_col: str = "task_id") -> DataFrame:
    """One stage's event rows, with the stage's fields cast to their types; fields that ``df`` lacks are null."""
    fields = T.StructType.fromDDL(STAGE_EVENTS[stage]).fields
    columns = {f.name: (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType) for f in fields}
    return event_rows(df, stage, task_col, **columns)


def _parse_event_lines(rows: DataFrame, *carry: str) -> DataFrame:
    v = F.try_parse_json(F.col("value"))
    return rows.where(F.trim("value") != "").select(
        *carry,
        F.try_variant_get(v, "$.event", "string").alias("event"),
        F.try_to_timestamp(F.try_variant_get(v, "$.timestamp", "string")).alias("timestamp"),
        F.try_variant_get(v, "$.task_id", "string").alias("task_id"),
        v.alias("payload"),
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Batch read of the event log; unknown keys stay in ``payload`` (VARIANT)."""
    return _parse_event_lines(spark.read.text(path))


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Batch read of the event log with each line's place: (seq, event, timestamp, task_id, payload)."""
    rows = files.positioned(spark, path)
    return _parse_event_lines(rows, "seq")


def event_line_stream(spark: SparkSession, path: str) -> DataFrame:
    """Streaming tail of an event log whose files may also grow; lines as in ``event_lines``."""
    lines.register(spark)
    return _parse_event_lines(spark.readStream.format("positioned_lines").load(path), "seq")


def event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming tail of the event log directory."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return _parse_event_lines(r.load(path))


def json_stream(spark: SparkSession, path: str, schema: T.StructType,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming JSON source with an explicit schema."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.json(path)


def stream_checkpoint(spark: SparkSession, name: str, checkpoint: str | None = None) -> str:
    """The stream's checkpoint: as given, or by its name under ``spark.checkpoint.dir`` itself,
    so that a later session goes on where this one ends."""
    if checkpoint:
        return checkpoint
    folder = shared_folder(spark)
    if not folder:
        raise ValueError("a stream needs a checkpoint path, or spark.checkpoint.dir to be set")
    return os.path.join(folder, "streams", name)


def _start(stream: DataFrame, sink, name: str, checkpoint: str | None, outputs: list[str], available_now: bool,
           mode: str = "append"):
    spark = stream.sparkSession
    where = stream_checkpoint(spark, name, checkpoint)
    for path in outputs:
        claim(spark, path, where)
    w = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", where)
    return (w.trigger(availableNow=True) if available_now else w).start()


# ---------------------------------------------------------------------------
# Running counts
# ---------------------------------------------------------------------------
def running_cluster_counts(stream: DataFrame, cluster_col: str = "failure_cluster") -> DataFrame:
    """Stateful count per cluster (state: one row per cluster label)."""
    return stream.groupBy(F.col(cluster_col).alias("cluster_name")).agg(F.count(F.lit(1)).alias("n"))


def start_counts_to_table(stream: DataFrame, out_path: str, name: str, checkpoint: str | None = None,
                          available_now: bool = True):
    """Keep the complete running counts as the state at ``out_path``, version = batch."""
    return _start(running_cluster_counts(stream), lambda df, batch_id: write_state(df, out_path, batch_id),
                  name, checkpoint, [out_path], available_now, "complete")


# ---------------------------------------------------------------------------
# Online failure clustering
# ---------------------------------------------------------------------------
def online_clustering_batch(batch: DataFrame, batch_id: int, store_path: str, centroid_path: str,
                            alpha: float = 0.1, vec_col: str = "embedding", order_col: str = "seq") -> None:
    """One micro-batch: assign, store, update centroids (mini-batch EMA).

    Reads centroid version ``batch_id`` (version 0 is the initial set) and writes version
    ``batch_id + 1``. Without centroids they are fitted on the first batch that has rows.
    """
    spark = batch.sparkSession
    cur = read_state(spark, centroid_path, CENTROIDS, batch_id)
    if cur is not None and cur.isEmpty():
        cur = None
    rows = batch.persist()
    try:
        if cur is None and not rows.isEmpty():
            cur = cluster.fit(rows, None, vec_col=vec_col, order_col=order_col)
            moved = cur
        else:
            moved = None if cur is None else cluster.ema_update(rows, cur, alpha=alpha, vec_col=vec_col,
                                                                order_col=order_col)
        assigned = cluster.assign(rows, cur, vec_col)
        records = assigned.withColumn("failure_cluster", F.col("cluster_name")) \
            .drop("cluster_idx", "cluster_name", "similarity")
        write_batch(records, store_path, batch_id + 1)
        if moved is not None:
            write_state(moved.select("cluster_idx", "cluster_name", "centroid"), centroid_path, batch_id + 1)
    finally:
        rows.unpersist()


def start_online_clustering(stream: DataFrame, store_path: str, centroid_path: str, name: str, alpha: float = 0.1,
                            checkpoint: str | None = None, available_now: bool = True):
    return _start(stream, lambda df, bid: online_clustering_batch(df, bid, store_path, centroid_path, alpha),
                  name, checkpoint, [store_path, centroid_path], available_now)


# ---------------------------------------------------------------------------
# Incremental replay buffer
# ---------------------------------------------------------------------------
def buffer_batch(batch: DataFrame, batch_id: int, path: str, capacity: int) -> None:
    """Buffer version ``batch_id + 1`` = newest ``capacity`` rows of version ``batch_id`` plus the batch."""
    schema = T.StructType(batch.schema.fields)
    write_state(buf.append(read_state(batch.sparkSession, path, schema, batch_id), batch, capacity=capacity),
                path, batch_id + 1)


def start_buffer(stream: DataFrame, buffer_path: str, name: str, capacity: int = 10_000,
                 checkpoint: str | None = None, available_now: bool = True):
    return _start(stream, lambda df, bid: buffer_batch(df, bid, buffer_path, capacity), name, checkpoint,
                  [buffer_path], available_now)


# ---------------------------------------------------------------------------
# Sample summary
# ---------------------------------------------------------------------------
def summary_batch(batch: DataFrame, batch_id: int, path: str, n: int, seed: int = 42) -> None:
    """Summary version ``batch_id + 1`` = version ``batch_id`` merged with the batch's own; bounded by ``n`` for each cluster."""
    new = sampling.summarise(batch, n, seed)
    write_state(sampling.merge(read_state(batch.sparkSession, path, new.schema, batch_id), new, n), path, batch_id + 1)


def start_summary(stream: DataFrame, path: str, name: str, n: int, seed: int = 42, checkpoint: str | None = None,
                  available_now: bool = True):
    """Keep the summary of all examples of the stream, for samples of up to ``n`` rows by any later rates."""
    return _start(stream, lambda df, bid: summary_batch(df, bid, path, n, seed), name, checkpoint, [path], available_now)
