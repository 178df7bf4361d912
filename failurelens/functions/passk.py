"""Unbiased pass@k estimator as a Column expression.

pass@k = 1 - prod_{i=0}^{k-1} (n - c - i) / (n - i), and 1.0 when n - c < k
(Chen et al., 2021). Negative inputs, k > n or c > n raise an error at run time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def pass_at_k(n, c, k, validate: bool = True) -> Column:
    """Per-row pass@k for ``n`` samples with ``c`` correct (columns or ints)."""
    n, c, k = _c(n).cast("bigint"), _c(c).cast("bigint"), _c(k).cast("bigint")
    # k = 0 gives the empty product 1.0 -> pass@0 = 0.0; sequence(0, -1) would not be empty
    steps = F.when(k > 0, F.sequence(F.lit(0).cast("bigint"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    prod = F.aggregate(steps, F.lit(1.0).cast("double"),
                       lambda acc, i: acc * (n - c - i).cast("double") / (n - i).cast("double"))
    value = F.when(n - c < k, F.lit(1.0)).otherwise(F.lit(1.0) - prod)
    if not validate:
        return value
    return (
        F.when((n < 0) | (c < 0) | (k < 0),
               F.raise_error(F.concat(F.lit("pass@k inputs must be non-negative: n="), n.cast("string"),
                                      F.lit(", c="), c.cast("string"), F.lit(", k="), k.cast("string"))))
        .when(k > n, F.raise_error(F.concat(F.lit("k ("), k.cast("string"),
                                            F.lit(") cannot exceed num_samples ("), n.cast("string"), F.lit(")"))))
        .when(c > n, F.raise_error(F.concat(F.lit("num_correct ("), c.cast("string"),
                                            F.lit(") cannot exceed num_samples ("), n.cast("string"), F.lit(")"))))
        .otherwise(value)
        .cast("double")
    )
