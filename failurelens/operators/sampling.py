"""Curriculum samples from a bounded, mergeable summary of the buffer.

A weighted sample keeps the rows with the least -ln(u) / w. Weights are equal inside a
cluster, so whatever the clusters' failure rates will be, only the n rows with the greatest u
of each cluster can be drawn; a uniform sample needs the n rows with the least u. The summary
holds these and the clusters' row counts: at most 2 n rows for each cluster, however many
rows were seen. Summaries of parts merge into that of the whole, so one is carried from
batch to batch, and any later rates are answered exactly, without the buffer.

Defined results: u is that of ``buffer.hash_uniform`` over ``seq``; ties go by ``seq``; a null cluster is
a cluster of its own without a rate; empty parts change nothing. Each row enters once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failurelens.operators.buffer import hash_uniform
from failurelens.operators.topk import top_k

#: Partitions are dealt into so many groups that keep their own rows first.
GROUPS = 64
#: Kinds of rows: greatest and least u of a cluster, and a cluster's count.
HIGH, LOW, COUNT = "high", "low", "count"


def _kept(rows: DataFrame, n: int, cluster: str) -> DataFrame:
    """The first ``n`` rows by ``_order``, ``seq`` for each kind and cluster: in partitions, in groups of these, overall."""
    order = [F.col("_order"), F.col("seq")]
    for keys in (["kind", cluster, "_group"], ["kind", cluster]):
        w = Window.partitionBy(*keys).orderBy(*order)
        rows = rows.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")
    return rows


def _merged(rows: DataFrame, n: int, cluster: str) -> DataFrame:
    kept = _kept(rows.where(F.col("kind") != COUNT)
                 .withColumn("_order", F.when(F.col("kind") == HIGH, -F.col("u")).otherwise(F.col("u")))
                 .withColumn("_group", F.spark_partition_id() % GROUPS), n, cluster).drop("_order", "_group")
    counts = rows.where(F.col("kind") == COUNT).groupBy("kind", cluster).agg(F.sum("n_rows").alias("n_rows"))
    return kept.unionByName(counts, allowMissingColumns=True)


def summarise(rows: DataFrame, n: int, seed: int = 42, cluster: str = "failure_cluster") -> DataFrame:
    """The summary of ``rows`` (kind, u, n_rows and the columns of ``rows``) for samples of up to ``n`` rows."""
    own = rows.withColumn("u", hash_uniform("seq", seed)).withColumn("n_rows", F.lit(1).cast("bigint"))
    ends = own.withColumn("kind", F.explode(F.array(F.lit(HIGH), F.lit(LOW)))).withColumn("n_rows", F.lit(None).cast("bigint"))
    counts = own.groupBy(cluster).agg(F.sum("n_rows").alias("n_rows")).withColumn("kind", F.lit(COUNT))
    return _merged(ends.unionByName(counts, allowMissingColumns=True), n, cluster)


def merge(a: DataFrame | None, b: DataFrame, n: int, cluster: str = "failure_cluster") -> DataFrame:
    """The summary of both parts' rows."""
    return b if a is None else _merged(a.unionByName(b), n, cluster)


def _weight(rate: Column, amplification: float) -> Column:
    return F.lit(1.0) + F.coalesce(rate, F.lit(0.0)) * F.lit(amplification)


def draw_weighted(summary: DataFrame, n: int, rates: DataFrame | None, amplification: float = 5.0,
                  cluster: str = "failure_cluster") -> DataFrame:
    """The rows that ``buffer.sample_weighted`` draws from all rows, with raw_weight and weight."""
    if rates is None:
        told = summary.withColumn("raw_weight", F.lit(1.0))
    else:
        r = rates.select(F.col("cluster_name").alias("_cl"), F.col("failure_rate").alias("_rate"))
        told = (summary.join(r, summary[cluster] == F.col("_cl"), "left")
                .withColumn("raw_weight", _weight(F.col("_rate"), amplification)).drop("_cl", "_rate"))
    total = told.where(F.col("kind") == COUNT).select(F.sum(F.col("n_rows") * F.col("raw_weight"))).scalar()
    keyed = told.where(F.col("kind") == HIGH).withColumn("_key", -F.log("u") / F.col("raw_weight"))
    return (top_k(keyed, n, "_key", descending=False, tie_cols=[F.col("seq").asc()])
            .withColumn("weight", F.col("raw_weight") / total).drop("_key", "kind", "n_rows", "u"))


def draw_uniform(summary: DataFrame, n: int) -> DataFrame:
    """The rows that ``buffer.sample_uniform`` draws from all rows."""
    low = summary.where(F.col("kind") == LOW)
    return top_k(low, n, "u", descending=False, tie_cols=[F.col("seq").asc()]).drop("kind", "n_rows", "u")


def distribution(summary: DataFrame, cluster: str = "failure_cluster") -> DataFrame:
    """Rows seen for each cluster."""
    return summary.where(F.col("kind") == COUNT).select(cluster, F.col("n_rows").alias("n"))
