"""Routing labels as columns, attempt counters, and ablation topologies.

A per-task pipeline decides the next stage one task at a time; here the same
rules label every recorded attempt at once, so funnels and stuck tasks are
plain aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from failurelens.schemas import (ABLATION_RUNS, STAGE_DISTILLATION, STAGE_EXPERT_REPAIR, STAGE_FAILURE_ANALYSIS,
                                 STAGE_RE_EXECUTE, STAGE_SUCCESS_STORE)


def _c(x, default=None) -> Column:
    if x is None:
        return F.lit(default)
    return F.col(x) if isinstance(x, str) else x


def after_execution(success="success") -> Column:
    """success -> success_store, else failure_analysis (null counts as failure)."""
    return F.when(F.coalesce(_c(success), F.lit(False)), F.lit(STAGE_SUCCESS_STORE)) \
        .otherwise(F.lit(STAGE_FAILURE_ANALYSIS))


def after_repair(verified="repair_verified", attempt="attempt", max_attempts=None) -> Column:
    """verified -> re_execute; attempts left -> expert_repair; else distillation.
    Defaults: attempt 0, max 3, verified false."""
    v = F.coalesce(_c(verified), F.lit(False))
    a = F.coalesce(_c(attempt), F.lit(0))
    m = F.coalesce(_c(max_attempts, 3), F.lit(3))
    return F.when(v, F.lit(STAGE_RE_EXECUTE)).when(a < m, F.lit(STAGE_EXPERT_REPAIR)) \
        .otherwise(F.lit(STAGE_DISTILLATION))


def after_re_execution(success="success", attempt="attempt", max_attempts=None) -> Column:
    """success -> distillation; attempts left -> failure_analysis; else distillation."""
    s = F.coalesce(_c(success), F.lit(False))
    a = F.coalesce(_c(attempt), F.lit(0))
    m = F.coalesce(_c(max_attempts, 3), F.lit(3))
    return F.when(s, F.lit(STAGE_DISTILLATION)).when(a < m, F.lit(STAGE_FAILURE_ANALYSIS)) \
        .otherwise(F.lit(STAGE_DISTILLATION))


#: Up to a million rows to a window; a key's 10**12 rows then have a million buckets.
BUCKETS = (1 << 20,)


def running_count(df: DataFrame, key_col: str, order_col: str, flag: Column, out_col: str,
                  buckets: Sequence[int] = BUCKETS) -> DataFrame:
    """Per key, the number of rows up to and including this one (in ``order_col``
    order) where ``flag`` holds. Null keys are one group; a null order comes first.

    The prefix sum is taken in levels of ever wider order buckets: a window inside each
    (key, narrowest bucket) counts the rows, a window over the buckets' totals inside the
    next wider one gives their offsets, and so on; the last level has one row for each
    widest bucket. So a key holding a third of all rows is spread over many tasks at each
    level, and rows are shuffled once. Any ``buckets`` give the same counts; with none,
    one window per key does.
    """
    f = F.when(flag, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    names = [f"_b{i}" for i in range(len(buckets))]
    rows = df.withColumns({n: F.floor(F.col(order_col) / F.lit(w)).cast("bigint")
                           for n, w in zip(names, buckets, strict=True)} | {"_f": f})
    first = Window.partitionBy(key_col, *names[:1]).orderBy(order_col)
    out = rows.withColumn(out_col, F.sum("_f").over(first.rowsBetween(Window.unboundedPreceding, 0)))
    # a bucket's last running count is its total, so totals come from the same shuffle
    totals = out.groupBy(key_col, *names).agg(F.max(out_col).alias("_n"))
    for i, name in enumerate(names):
        inside = Window.partitionBy(key_col, *names[i + 1:i + 2]).orderBy(name)
        offsets = totals.withColumn("_off", F.coalesce(
            F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        side = offsets.select(F.col(key_col).alias("_k"), F.col(name).alias("_b"), "_off")
        out = (out.join(side, F.col(key_col).eqNullSafe(F.col("_k")) & F.col(name).eqNullSafe(F.col("_b")))
               .withColumn(out_col, F.col(out_col) + F.col("_off")).drop("_k", "_b", "_off"))
        totals = totals.groupBy(key_col, *names[i + 1:]).agg(F.sum("_n").alias("_n"))
    return out.drop(*names, "_f")


def with_attempts(results: DataFrame, task_col: str = "task_id", order_col: str = "sample_id",
                  buckets: Sequence[int] = BUCKETS) -> DataFrame:
    """Attempt number = running count of failed executions of the task so far."""
    return running_count(results, task_col, order_col, ~F.coalesce(F.col("success"), F.lit(False)),
                         "attempt", buckets)


def ablation_flags(spark: SparkSession) -> DataFrame:
    """The five preset runs and their four flags."""
    return spark.createDataFrame(ABLATION_RUNS, "run_name string, use_agentic_repair boolean, "
                                 "use_distillation boolean, use_failure_clustering boolean, "
                                 "use_adaptive_curriculum boolean")


def edge_targets(repair: bool, distill: bool) -> list[tuple[str, str, str]]:
    """(edge, label, target node) for a topology; edges absent from it are omitted."""
    ex = "after_execution"
    if not repair and not distill:
        return [(ex, STAGE_SUCCESS_STORE, STAGE_SUCCESS_STORE), (ex, STAGE_FAILURE_ANALYSIS, STAGE_SUCCESS_STORE)]
    rows = [(ex, STAGE_SUCCESS_STORE, STAGE_SUCCESS_STORE), (ex, STAGE_FAILURE_ANALYSIS, STAGE_FAILURE_ANALYSIS)]
    if not repair:
        return rows
    end = STAGE_DISTILLATION if distill else STAGE_SUCCESS_STORE
    rows += [("after_repair", STAGE_RE_EXECUTE, STAGE_RE_EXECUTE),
             ("after_repair", STAGE_EXPERT_REPAIR, STAGE_EXPERT_REPAIR),
             ("after_repair", STAGE_DISTILLATION, end),
             ("after_re_execution", STAGE_DISTILLATION, end),
             ("after_re_execution", STAGE_FAILURE_ANALYSIS, STAGE_FAILURE_ANALYSIS)]
    return rows


def topology(spark: SparkSession) -> DataFrame:
    """(run_name, edge, label, target) for every preset run: at most 7 rows per run."""
    rows = [(run, e, lab, tgt) for run, rep, dis, _, _ in ABLATION_RUNS for e, lab, tgt in edge_targets(rep, dis)]
    return spark.createDataFrame(rows, "run_name string, edge string, label string, target string")


def funnel(labels: DataFrame, spark: SparkSession) -> DataFrame:
    """Counts per (run, edge, target): label counts are aggregated first, then
    joined on (edge, label) to the small topology table; no row is replicated
    per run before aggregation."""
    long = labels.select(F.inline(F.array(
        F.struct(F.lit("after_execution").alias("edge"), F.col("after_execution").alias("label")),
        F.struct(F.lit("after_repair").alias("edge"), F.col("after_repair").alias("label")),
        F.struct(F.lit("after_re_execution").alias("edge"), F.col("after_re_execution").alias("label")),
    )))
    counts = long.groupBy("edge", "label").agg(F.count(F.lit(1)).alias("n"))
    return (counts.join(F.broadcast(topology(spark)), on=["edge", "label"], how="inner")
            .groupBy("run_name", "edge", "target").agg(F.sum("n").alias("n")))
