"""Exact vector top-k through a pivot index: most rows are ruled out by angles, unread or unscored.

The index deals each vector to the nearest of ``n_pivots`` stored vectors and keeps its angle to
that pivot; files are cut and sorted by (pivot, angle). For a query at the angle ``t`` from a
pivot, a row at the angle ``r`` from it is at least ``|t - r|`` away, so rows that can reach a
known similarity lie in one angle range for each pivot. The search takes two passes:

1. the nearest groups that hold k rows give each query a k-th best similarity, a lower bound;
2. of the other groups only the ranges that can reach that bound are read (the ranges are pushed
   to the scan as row-group filters) and scored.

Rows equal to the bound are kept, so the result is that of scoring all pairs: nothing is
approximate. How much is ruled out depends on the data: much where vectors lie in clusters,
little where they point evenly into many dimensions, since all angles are alike there. Pivots and group summaries are bounded by ``n_pivots``, queries by ``max_broadcast``.

Defined results: null vectors and those of another length than the pivots have no similarity and
are left out; a zero vector is similar 0 to all; ties go to the smaller id; an empty store or an
empty set of queries gives no rows; query ids that repeat with the same vector count once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from failurelens.operators.similarity import EPS, MAX_BROADCAST_QUERIES
from failurelens.session import scratch_path, ship_package

#: Vectors that rows are dealt to.
N_PIVOTS = 64
#: Added to each angle range, for rounding.
SLACK = 1e-6
#: Terms of the filter on index rows.
MAX_TERMS = 24
#: Similarities scored at once (64 MB of doubles).
MAX_CELLS = 8_000_000


@dataclass(frozen=True)
class PivotIndex:
    """Where the index rows lie, its pivots and, for each pivot, (rows, least norm, largest norm)."""

    path: str
    id_type: T.DataType
    pivots: np.ndarray
    groups: np.ndarray

    def rows(self, spark: SparkSession) -> DataFrame:
        """(id, vec, norm, angle, pivot); ``vec`` divided by its norm + 1e-8."""
        schema = T.StructType([T.StructField("id", self.id_type), T.StructField("vec", T.ArrayType(T.DoubleType())),
                               T.StructField("norm", T.DoubleType()), T.StructField("angle", T.DoubleType()),
                               T.StructField("pivot", T.IntegerType())])
        return spark.read.schema(schema).parquet(self.path)


def _scaled(mat: np.ndarray) -> np.ndarray:
    return mat / (np.linalg.norm(mat, axis=1, keepdims=True) + EPS)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between the rows of two matrices; those of a zero row are 0."""
    def unit(m):
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norm > 0, norm, 1), norm[:, 0] > 0
    (ua, real_a), (ub, real_b) = unit(a), unit(b)
    out = np.arccos(np.clip(ua @ ub.T, -1, 1))
    return np.where(real_a[:, None] & real_b[None, :], out, 0.0)


def build_index(store: DataFrame, id_col: str = "record_id", vec_col: str = "embedding", n_pivots: int = N_PIVOTS,
                path: str | None = None) -> PivotIndex:
    """Write the index of ``store``; pivots are the rows whose hashed ids come first.

    One pass deals the rows, one shuffle by range of (pivot, angle, id) sorts them: a group
    of any size, also one of equal vectors, is cut into as many files as its rows need.
    """
    spark = store.sparkSession
    ship_package(spark)
    path = path or scratch_path(spark, f"pivot-index-{uuid.uuid4().hex}")
    vectors = store.where(F.col(vec_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    some = vectors.where(F.size("vec") > 0).orderBy(F.xxhash64("id"), "id").limit(n_pivots).select("vec").collect()
    dim = len(some[0][0]) if some else 0
    pivots = _scaled(np.array([r[0] for r in some if len(r[0]) == dim], np.float64).reshape(-1, dim) if dim
                     else np.zeros((0, 0)))
    pivots = np.unique(pivots, axis=0)
    sent = spark.sparkContext.broadcast(pivots)
    id_type = store.schema[id_col].dataType

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = sent.value
        for pdf in batches:
            if pdf.empty:
                continue
            for first in range(0, len(pdf), 2048):
                part = pdf.iloc[first:first + 2048]
                vec = _scaled(np.stack(part["vec"].to_numpy()).astype(np.float64))
                angle = _angles(vec, p)
                nearest = angle.argmin(1)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vec": list(vec), "norm": np.linalg.norm(vec, axis=1),
                                    "angle": angle[np.arange(len(vec)), nearest], "pivot": nearest.astype(np.int32)})

    schema = T.StructType([T.StructField("id", id_type), T.StructField("vec", T.ArrayType(T.DoubleType())),
                           T.StructField("norm", T.DoubleType()), T.StructField("angle", T.DoubleType()),
                           T.StructField("pivot", T.IntegerType())])
    dealt = vectors.where(F.size("vec") == dim).mapInPandas(deal, schema) if dim else spark.createDataFrame([], schema)
    (dealt.repartitionByRange("pivot", "angle", "id").sortWithinPartitions("pivot", "angle")
     .write.partitionBy("pivot").parquet(path))
    index = PivotIndex(path, id_type, pivots, np.zeros((len(pivots), 3)))
    held = (index.rows(spark).groupBy("pivot")
            .agg(F.count(F.lit(1)), F.min("norm"), F.max("norm")).collect())  # at most n_pivots rows
    for pivot, *numbers in held:
        index.groups[pivot] = numbers
    return index


def first_groups(index: PivotIndex, queries: np.ndarray, k: int) -> np.ndarray:
    """(queries, pivots): the nearest groups that together hold ``k`` rows."""
    angle = _angles(queries, index.pivots)
    order = np.argsort(angle, axis=1, kind="stable")
    before = np.cumsum(index.groups[order, 0], axis=1) - index.groups[order, 0]
    chosen = np.zeros(angle.shape, bool)
    np.put_along_axis(chosen, order, before < k, axis=1)
    return chosen


def reachable(index: PivotIndex, queries: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angle ranges (queries, pivots) outside of which no row is as similar as the query's ``bound``."""
    angle = _angles(queries, index.pivots)
    size = np.linalg.norm(queries, axis=1)
    # similarity is cosine x both norms: the cosine needed is least at the largest norm, for negative bounds the least
    norm = np.where(bound[:, None] > 0, index.groups[None, :, 2], index.groups[None, :, 1]) * size[:, None]
    needed = np.divide(bound[:, None], norm, out=np.full(angle.shape, -1.0), where=norm > 0)
    needed = np.where((norm <= 0) & (bound[:, None] > 0), np.inf, needed)
    widest = np.where(needed <= -1, np.pi, np.arccos(np.clip(needed, -1, 1))) + SLACK
    out_of_reach = needed > 1 + 1e-9
    return np.where(out_of_reach, np.inf, angle - widest), np.where(out_of_reach, -np.inf, angle + widest)


def _wanted(rows: DataFrame, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """The index rows that may lie in a query's range, as a filter on partitions and sorted files.

    Pivots with near ranges share a term, so the filter has at most MAX_TERMS of them."""
    least, most = low.min(0, initial=np.inf), high.max(0, initial=-np.inf)
    used = np.flatnonzero(least <= most)
    used = used[np.argsort(least[used], kind="stable")]
    asked = F.lit(False)
    for some in np.array_split(used, min(MAX_TERMS, len(used)) or 1):
        if len(some):
            asked = asked | (F.col("pivot").isin(some.tolist())
                             & F.col("angle").between(float(least[some].min()), float(most[some].max())))
    return rows.where(asked)


def _pairs(pdf: pd.DataFrame, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, queries, in range) of a batch, pivot by pivot; a query without a row in range is left out."""
    angle, pivot = pdf["angle"].to_numpy(), pdf["pivot"].to_numpy()
    for p in np.unique(pivot):
        rows = np.flatnonzero(pivot == p)
        near = np.flatnonzero((low[:, p] <= angle[rows].max()) & (high[:, p] >= angle[rows].min()))
        step = max(1, MAX_CELLS // max(1, len(near)))
        for first in range(0, len(rows) if len(near) else 0, step):
            some = rows[first:first + step]
            yield some, near, (angle[some, None] >= low[near, p]) & (angle[some, None] <= high[near, p])


def _best(index: PivotIndex, spark: SparkSession, qids: list, qid_type: T.DataType, queries: np.ndarray, k: int,
          low: np.ndarray, high: np.ndarray) -> DataFrame:
    """(query_id, id, similarity): each partition's top ``k`` of each query among the rows in its ranges."""
    sent = spark.sparkContext.broadcast((np.array(qids), queries, low, high))

    def best(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True).sort_values(["q", "similarity", "id"], ascending=[True, False, True])
        return rows.groupby("q", sort=False).head(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q, lo, hi = sent.value
        held: list[pd.DataFrame] = []
        n_held, floor = 0, np.full(len(q), -np.inf)
        for pdf in batches:
            if pdf.empty:
                continue
            vec, ids = np.stack(pdf["vec"].to_numpy()), pdf["id"].to_numpy()
            for rows, near, inside in _pairs(pdf, lo, hi):
                sims = np.where(inside, vec[rows] @ q[near].T, -np.inf)
                cut = floor[near]
                if len(rows) > k:
                    cut = np.maximum(cut, np.partition(sims, len(rows) - k, axis=0)[len(rows) - k])
                at, of = np.nonzero((sims >= cut) & inside)
                held.append(pd.DataFrame({"q": near[of], "id": ids[rows[at]], "similarity": sims[at, of]}))
                n_held += len(at)
                if n_held > 4 * k * len(q):
                    held = [best(held)]
                    n_held = len(held[0])
                    full = held[0].groupby("q")["similarity"].agg(["size", "min"])
                    full = full[full["size"] >= k]
                    floor[full.index.to_numpy()] = full["min"].to_numpy()
        if held:
            out = best(held)
            yield pd.DataFrame({"query_id": names[out["q"].to_numpy()], "id": out["id"], "similarity": out["similarity"]})

    schema = T.StructType([T.StructField("query_id", qid_type), T.StructField("id", index.id_type),
                           T.StructField("similarity", T.DoubleType())])
    return _wanted(index.rows(spark), low, high).mapInPandas(run, schema)


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("id").asc())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _ranges(index: PivotIndex, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that take the chosen groups whole."""
    return np.where(chosen, -np.inf, np.inf), np.where(chosen, np.inf, -np.inf)


def search(index: PivotIndex, queries: DataFrame, k: int = 5, id_col: str = "record_id", query_id_col: str = "query_id",
           query_vec_col: str = "query_vec", max_broadcast: int = MAX_BROADCAST_QUERIES) -> tuple[DataFrame, DataFrame]:
    """The top ``k`` rows of each query, and what they cost.

    The first table is (query_id, <id_col>, similarity, rank), the rows that
    ``similarity.top_k_similar`` gives. The second, (query_id, rows_scored, rows_indexed), counts
    when it is asked. More than ``max_broadcast`` queries are an error: search them in parts.
    """
    spark = queries.sparkSession
    ship_package(spark)
    qid_type = queries.schema[query_id_col].dataType
    asked = (queries.where(F.col(query_vec_col).isNotNull())
             .select(F.col(query_id_col).alias("q"), F.col(query_vec_col).cast("array<double>").alias("v")).distinct()
             .limit(max_broadcast + 1).collect())
    if len(asked) > max_broadcast:
        raise ValueError(f"more than {max_broadcast} queries at once")
    dim = index.pivots.shape[1]
    asked = [r for r in asked if dim and len(r[1]) == dim]
    qids = [r[0] for r in asked]
    q = _scaled(np.array([r[1] for r in asked], np.float64).reshape(len(asked), dim))

    chosen = first_groups(index, q, k)
    low, high = _ranges(index, chosen)
    name = scratch_path(spark, f"pivot-first-{uuid.uuid4().hex}")
    _top(_best(index, spark, qids, qid_type, q, k, low, high), k).drop("rank").write.parquet(name)
    first = spark.read.parquet(name)
    held = {r[0]: (r[1], r[2]) for r in first.groupBy("query_id").agg(F.count(F.lit(1)), F.min("similarity")).collect()}
    bound = np.array([held[i][1] if held.get(i, (0,))[0] >= k else -np.inf for i in qids])
    low2, high2 = reachable(index, q, bound)
    low2, high2 = np.where(chosen, np.inf, low2), np.where(chosen, -np.inf, high2)
    found = first.unionByName(_best(index, spark, qids, qid_type, q, k, low2, high2))
    top = _top(found, k).select(F.col("query_id").alias(query_id_col), F.col("id").alias(id_col), "similarity", "rank")
    return top, _cost(index, spark, qids, qid_type, np.minimum(low, low2), np.maximum(high, high2), query_id_col)


def _cost(index: PivotIndex, spark: SparkSession, qids: list, qid_type: T.DataType, low: np.ndarray, high: np.ndarray,
          query_id_col: str) -> DataFrame:
    """(query_id, rows_scored, rows_indexed): a row is scored if it lies in a range of the query."""
    sent = spark.sparkContext.broadcast((np.array(qids), low, high))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, lo, hi = sent.value
        n = np.zeros(len(names), np.int64)
        for pdf in batches:
            for _, near, inside in _pairs(pdf, lo, hi):
                n[near] += inside.sum(0)
        yield pd.DataFrame({"query_id": names, "n": n})

    schema = T.StructType([T.StructField("query_id", qid_type), T.StructField("n", T.LongType())])
    rows = index.rows(spark).select("pivot", "angle").mapInPandas(count, schema)
    return (rows.groupBy("query_id").agg(F.sum("n").alias("rows_scored"))
            .withColumn("rows_indexed", F.lit(int(index.groups[:, 0].sum())).cast("bigint"))
            .withColumnRenamed("query_id", query_id_col))
