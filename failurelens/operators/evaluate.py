"""Benchmark scoring: correct counts per task, pass@k, metric rows.

Shuffles: one partial+final hash aggregate on ``task_id`` (map-side combine, so a
hot task costs one partial row per input partition), then a tiny aggregate per
benchmark. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from failurelens.functions.passk import pass_at_k


def expand_samples(tasks: DataFrame, num_samples: int, sample_col: str = "sample_id") -> DataFrame:
    """Task x sample expansion: one row per (task, sample in 0..n-1). Narrow (explode)."""
    return tasks.withColumn(sample_col, F.explode(F.sequence(F.lit(0), F.lit(num_samples - 1))))


def correct_counts(results: DataFrame, task_col: str = "task_id", success_col: str = "success",
                   tasks: DataFrame | None = None, num_samples: int | None = None,
                   group_cols: Sequence[str] = ()) -> DataFrame:
    """Per task: ``n`` samples and ``c`` correct samples.

    ``num_samples`` fixes n (a failed or missing sample counts as incorrect);
    otherwise n is the number of recorded samples. With ``tasks`` given, tasks
    with no recorded sample still appear with c = 0.
    """
    keys = [*group_cols, task_col]
    counts = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.coalesce(F.col(success_col), F.lit(False))).alias("c"),
    )
    if tasks is not None:
        counts = tasks.select(*keys).distinct().join(counts, on=keys, how="left")
    n = F.lit(num_samples).cast("bigint") if num_samples is not None else F.coalesce(F.col("_n"), F.lit(0))
    return counts.select(*keys, n.alias("n"), F.coalesce(F.col("c"), F.lit(0)).cast("bigint").alias("c"))


def with_pass_at_k(counts: DataFrame, ks: Sequence[int] = (1, 5)) -> DataFrame:
    """Add ``pass_at_{k}`` per task row."""
    return counts.select("*", *[pass_at_k("n", "c", k).alias(f"pass_at_{k}") for k in ks])


def mean_pass_at_k(counts: DataFrame, ks: Sequence[int] = (1, 5), group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean pass@k over tasks; an empty input gives 0.0."""
    scored = with_pass_at_k(counts, ks)
    aggs = [F.coalesce(F.avg(f"pass_at_{k}"), F.lit(0.0)).alias(f"pass_at_{k}") for k in ks]
    aggs.append(F.count(F.lit(1)).alias("num_problems"))
    return scored.groupBy(*group_cols).agg(*aggs)


def benchmark_metrics(counts: DataFrame, benchmark_col: str = "benchmark", ks: Sequence[int] = (1, 5)) -> DataFrame:
    """Long metric rows ``(benchmark, metric, value)``: '<bench>/pass@k' and '<bench>/num_problems'."""
    wide = mean_pass_at_k(counts, ks, group_cols=[benchmark_col])
    prefix = F.concat(F.lower(F.col(benchmark_col)), F.lit("/"))
    pairs = [F.struct(F.concat(prefix, F.lit(f"pass@{k}")).alias("metric"),
                      F.col(f"pass_at_{k}").cast("double").alias("value")) for k in ks]
    pairs.append(F.struct(F.concat(prefix, F.lit("num_problems")).alias("metric"),
                          F.col("num_problems").cast("double").alias("value")))
    return wide.select(F.col(benchmark_col), F.inline(F.array(*pairs)))


def merge_metrics(*metric_tables: DataFrame, key_cols: Sequence[str] = ("metric",)) -> DataFrame:
    """Union metric tables; for a repeated key the later table wins."""
    tagged = [t.withColumn("_src", F.lit(i)) for i, t in enumerate(metric_tables)]
    u = tagged[0]
    for t in tagged[1:]:
        u = u.unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy(*key_cols).orderBy(F.col("_src").desc())
    return u.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_src")


class BenchmarkRunner:
    """Extension hook: a benchmark is a loader plus a scorer, both DataFrame functions.

    ``load(spark) -> problems`` and ``score(problems) -> results(task_id, success)``;
    ``run`` turns results into the standard metric rows.
    """

    def __init__(self, name: str, load: Callable, score: Callable, num_samples: int | None = None,
                 ks: Sequence[int] = (1, 5)):
        self.name, self.load, self.score = name, load, score
        self.num_samples, self.ks = num_samples, ks

    def run(self, spark) -> DataFrame:
        problems = self.load(spark)
        results = self.score(problems)
        counts = correct_counts(results, tasks=problems, num_samples=self.num_samples)
        return benchmark_metrics(counts.withColumn("benchmark", F.lit(self.name)), ks=self.ks)
