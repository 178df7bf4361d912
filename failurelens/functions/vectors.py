"""Dense-vector expressions over ``ARRAY<FLOAT|DOUBLE>`` columns (JVM higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    """Sum of element products, accumulated in double from left to right."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def l2_normalize(v) -> Column:
    """Unit-length copy; a zero vector stays zero.

    The squared norm is accumulated once and handed to the finish step, so the
    per-element division reads a lambda variable instead of re-summing the vector.
    """
    d = as_double(v)
    return F.aggregate(d, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x,
                       lambda ss: F.when(ss > 0, F.transform(d, lambda x: x / F.sqrt(ss))).otherwise(d))


def cosine_eps(a, b, eps: float = 1e-8) -> Column:
    """Cosine with ``eps`` added to each norm (a vector's self-similarity is just below 1)."""
    da, db = as_double(a), as_double(b)
    return dot(da, db) / ((norm(da) + F.lit(eps)) * (norm(db) + F.lit(eps)))


def literal_vector(values) -> Column:
    """A Python sequence of numbers as an ``ARRAY<DOUBLE>`` literal."""
    return F.array(*[F.lit(float(x)) for x in values]).cast("array<double>")
