"""Exact top-k that stays bounded when k is large.

``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: every partition sends
its own top k to one task, i.e. partitions x k rows. That is fine for small k;
for large k (a 10,000-row buffer over a table with 100,000 partitions) it is a
billion rows in one task. Above ``DIRECT_MAX`` the merge has a level between:
partitions are dealt into ``GROUPS`` groups, each keeps its own top k
(``row_number() <= k``, planned as a partial WindowGroupLimit before the
shuffle), and the last merge gets at most GROUPS x k rows. Which way is taken
depends on k only, never on the data, and both give the same rows: null keys
come last, ties go by ``tie_cols``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIRECT_MAX = 1_000
GROUPS = 64


def top_k(df: DataFrame, k: int, key: str, descending: bool, tie_cols: Sequence[Column] = (),
          direct_max: int = DIRECT_MAX, groups: int = GROUPS) -> DataFrame:
    """The first ``k`` rows ordered by ``key`` (nulls last), then ``tie_cols``."""
    order = [F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last(), *tie_cols]
    if k > direct_max:
        inside = Window.partitionBy("_group").orderBy(*order)
        df = (df.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(groups)))
              .withColumn("_rank", F.row_number().over(inside)).where(F.col("_rank") <= k).drop("_group", "_rank"))
    return df.orderBy(*order).limit(k)
