"""Task-level joins and filters: pairing code with tests, merging stage outputs.

Each stage table holds one row per (task_id, attempt); the merged task row
takes the latest attempt of every stage (max_by, partial aggregate) and joins
the stages on ``task_id`` (one shuffle per stage table, all on the same key).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failurelens.operators.store import latest_per_key


def pair_code_and_tests(codes: DataFrame, tests: DataFrame, keys: Sequence[str] = ("task_id", "sample_id")) -> DataFrame:
    """Code x test x entry point matched by position key; unmatched rows drop (shortest wins)."""
    return codes.join(tests, on=list(keys), how="inner")


def split_by_success(results: DataFrame, col: str = "success") -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(F.col(col), F.lit(False))
    return results.where(ok), results.where(~ok)


def merge_stages(stages: dict[str, DataFrame], task_col: str = "task_id", order_col: str = "attempt") -> DataFrame:
    """One row per task: latest attempt of each stage, columns prefixed by stage name."""
    out = None
    for name, df in stages.items():
        latest = latest_per_key(df, [task_col], [order_col]) if order_col in df.columns else df
        renamed = latest.select(task_col, *[F.col(c).alias(f"{name}_{c}") for c in latest.columns if c != task_col])
        out = renamed if out is None else out.join(renamed, on=task_col, how="left")
    return out
