"""Metric tables and reports: long-form metrics, round log, run comparison,
deltas between rounds and experiment summaries. All inputs are long tables
``(run_name, round, metric, value)``; every step is an aggregate or a window
over (run, metric) groups, which are small by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from failurelens.functions.text import fixed4, iso_utc, metric_cell


def to_long(df: DataFrame, id_cols: Sequence[str], metric_cols: dict[str, str]) -> DataFrame:
    """Wide metric columns -> rows ``(*id_cols, metric, value, integral)``; ``metric_cols`` maps column -> metric
    name. ``integral`` tells that the column holds whole numbers."""
    pairs = [F.struct(F.lit(name).alias("metric"), F.col(col).cast("double").alias("value"),
                      F.lit(isinstance(df.schema[col].dataType, T.IntegralType)).alias("integral"))
             for col, name in metric_cols.items()]
    return df.select(*id_cols, F.inline(F.array(*pairs)))


def _cell(metrics: DataFrame):
    return metric_cell("value", "integral" if "integral" in metrics.columns else None)


def log_round(existing: DataFrame | None, new: DataFrame, seq_col: str = "logged_at") -> DataFrame:
    """Insert or replace whole rounds: for each (run, round) the latest logging wins; a null round is one too.

    One pass: the latest logging of a round, which holds a handful of metrics, is a window
    over that round.
    """
    staged = new.withColumn("_v", F.lit(1))
    if existing is not None:
        staged = existing.withColumn("_v", F.lit(0)).unionByName(staged, allowMissingColumns=True)
    latest = F.max(F.struct("_v", seq_col)).over(Window.partitionBy("run_name", "round"))
    return staged.withColumn("_l", latest).where(F.struct("_v", seq_col).eqNullSafe(F.col("_l"))).drop("_v", "_l")


def report_rows(metrics: DataFrame) -> DataFrame:
    """Per-run report table: metrics sorted by name; whole numbers as they are, others with 4 decimals."""
    return metrics.select("*", _cell(metrics).alias("cell")).orderBy("run_name", "round", "metric")


def metric_names(metrics: DataFrame) -> DataFrame:
    """Distinct metric names across all runs, sorted."""
    return metrics.select("metric").distinct().orderBy("metric")


def compare_runs(metrics: DataFrame, runs: Sequence[str] | None = None) -> DataFrame:
    """Report cells ``(metric, run_name, cell)`` of every metric in every run; without the metric, 'N/A'.

    The runs are those of the table, or ``runs``. One partial aggregate for the metrics
    (a row holds its runs) and one for the runs' names.
    """
    names = F.array(*[F.lit(r) for r in runs]) if runs is not None else \
        metrics.select(F.array_sort(F.collect_set("run_name"))).scalar()
    cells = metrics.groupBy("metric", "run_name").agg(F.max(_cell(metrics)).alias("cell"))
    per = cells.groupBy("metric").agg(F.map_from_entries(F.collect_list(F.struct("run_name", "cell"))).alias("_of"))
    return (per.withColumn("_names", names).select("metric", "_of", F.explode("_names").alias("run_name"))
            .select("metric", "run_name", F.coalesce(F.try_element_at("_of", "run_name"), F.lit("N/A")).alias("cell")))


def round_deltas(metrics: DataFrame, metric_names_: Sequence[str] | None = None) -> DataFrame:
    """Change from the directly preceding round, per (run, metric).

    The delta exists only when the previous row is round - 1 and both values exist.
    """
    m = metrics if metric_names_ is None else metrics.where(F.col("metric").isin(*metric_names_))
    w = Window.partitionBy("run_name", "metric").orderBy("round")
    prev = F.lag(F.struct("round", "value")).over(w)
    return m.withColumn("_p", prev).select(
        "run_name", "round", "metric", "value",
        F.when((F.col("_p.round") == F.col("round") - 1) & F.col("_p.value").isNotNull() & F.col("value").isNotNull(),
               F.col("value") - F.col("_p.value")).alias("delta"))


def experiment_summary(metrics: DataFrame, key: str = "pass@1") -> DataFrame:
    """Per (run, round): the metrics whose name contains ``key`` as 'name: 0.0000',
    comma-joined in name order ('None' if there are none), plus rounds per run;
    with a ``timestamp`` column, also the run's first and last logging time."""
    timed = "timestamp" in metrics.columns
    per_round = metrics.groupBy("run_name", "round").agg(
        *([F.min("timestamp").alias("_ts")] if timed else []),
        F.array_sort(F.collect_list(F.when(F.col("metric").contains(key),
                                           F.concat(F.col("metric"), F.lit(": "),
                                                    fixed4("value")))))
        .alias("_ms"))
    rounds = Window.partitionBy("run_name")
    extra = [F.min("_ts").over(rounds).alias("started_at"), F.max("_ts").over(rounds).alias("ended_at")] \
        if timed else []
    return per_round.select(
        "run_name", "round",
        F.when(F.size("_ms") > 0, F.array_join("_ms", ", ")).otherwise(F.lit("None")).alias("key_metrics"),
        F.count(F.lit(1)).over(rounds).alias("total_rounds"),
        *extra,
    )


def step_totals(results: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Execution totals per group: tests passed/failed/total, time, successes; with the columns
    ``expert_called`` and ``repair_verified`` also how many repairs were asked for and held."""
    repairs = [F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(name)
               for c, name in (("expert_called", "experts_called"), ("repair_verified", "repairs_verified"))
               if c in results.columns]
    return results.groupBy(*group_cols).agg(
        F.sum("passed").alias("tests_passed"),
        F.sum("failed").alias("tests_failed"),
        F.sum("total").alias("tests_total"),
        F.avg("execution_time_ms").alias("avg_execution_time_ms"),
        F.count_if(F.col("success")).alias("task_success"),
        F.count(F.lit(1)).alias("executions"),
        *repairs,
    )


def metric_events(spark: SparkSession, metrics: DataFrame, step_col: str | None = None) -> DataFrame:
    """Metric rows stamped with the logging time (UTC ISO text) and optional step."""
    out = metrics.withColumn("timestamp", iso_utc(F.current_timestamp()))
    return out if step_col is None else out.withColumn("step", F.col(step_col))
