"""Failure clustering over unit-normalised embeddings.

Centroids are a k-row DataFrame ``(cluster_idx, cluster_name, centroid)``. k is
small and checked, so the centroid matrix is broadcast and assignment, fit and
update share one Arrow path; embeddings move through partial aggregates only.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from failurelens.functions.text import embed_input
from failurelens.functions.vectors import l2_normalize
from failurelens.operators.routing import running_count
from failurelens.schemas import CENTROIDS, CLUSTER_NAMES, UNKNOWN_CLUSTER
from failurelens.session import ship_package, small_frame

MAX_K = 1024
PACK_ROWS, STEP_ROWS = 128, 8192  # vectors in one packed block; vectors compared at once
TIE = 1e-12
# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------
# One exemplar text per cluster, in cluster order; extra clusters get the pad text.
ANCHOR_EXEMPLARS = [
    "SyntaxError: invalid syntax. IndentationError: unexpected indent.",
    "RuntimeError: TypeError: IndexError: list index out of range. KeyError.",
    "LogicError: Wrong output. Expected result does not match actual outcome. Mismatch in return value or logic flow.",
    "EdgeCaseError: Failed on empty input, boundary cases, extremum limits, zero, null values, or negative numbers.",
    "AlgorithmDesignError: Incorrect algorithm choice, suboptimal structural logic, recursion error, or strategy mismatch.",
    "EfficiencyError: TimeLimitExceeded, TimeoutError, memory limit exceeded, slow execution speed, or high complexity.",
]
ANCHOR_PAD = "Unknown failure pattern."


def _check_k(centroids: DataFrame, max_k: int = MAX_K) -> int:
    k = centroids.limit(max_k + 1).count()
    if k > max_k:
        raise ValueError(f"{k} centroids exceed the broadcast bound {max_k}")
    return k


def local_centroids(centroids: DataFrame, max_k: int = MAX_K) -> DataFrame:
    """The k centroids as a local relation (size-checked), computed once."""
    cols = centroids.select(F.col("cluster_idx").cast("int").alias("cluster_idx"), "cluster_name",
                            F.col("centroid").cast("array<double>").alias("centroid"))
    return small_frame(cols, max_k, "centroid table")


def assign(df: DataFrame, centroids: DataFrame | None, vec_col: str = "embedding",
           max_k: int = MAX_K) -> DataFrame:
    """Nearest centroid by cosine of the unit vector; lowest index wins ties.

    Adds ``cluster_idx``, ``cluster_name``, ``similarity``. Without centroids
    every row is 'Unknown'. A zero vector scores 0 everywhere -> index 0; a null
    vector, or one of another length than the centroids, gets index -1 and no name.
    The k centroids (checked) are collected and broadcast, and each Arrow batch is one
    matrix product: no shuffle of ``df``.
    """
    if centroids is None:
        return df.select("*", F.lit(None).cast("int").alias("cluster_idx"),
                         F.lit(UNKNOWN_CLUSTER).alias("cluster_name"),
                         F.lit(None).cast("double").alias("similarity"))
    from pyspark.sql.functions import pandas_udf
    spark = df.sparkSession
    ship_package(spark)
    rows = _collect_centroids(local_centroids(centroids, max_k))
    bc = spark.sparkContext.broadcast(_matrix(rows))

    @pandas_udf("struct<j:int,s:double>")
    def nearest(v: pd.Series) -> pd.DataFrame:
        j, s = nearest_rows(v, bc.value)
        return pd.DataFrame({"j": j, "s": s})

    idx = F.array(*[F.lit(i) for i, _, _ in rows])
    names = F.array(*[F.lit(n) for _, n, _ in rows])
    res = df.withColumn("_n", nearest(F.col(vec_col).cast("array<double>")))
    pos = F.col("_n.j") + 1
    # never null, so that joins on the index need no null filter, which would run the model again
    return (res.withColumn("cluster_idx", F.coalesce(F.when(pos > 0, F.element_at(idx, pos)), F.lit(-1)))
            .withColumn("cluster_name", F.when(pos > 0, F.element_at(names, pos)))
            .withColumn("similarity", F.when(pos > 0, F.col("_n.s")))
            .drop("_n"))


def _matrix(rows: Sequence[tuple[int, str, Sequence[float]]]) -> np.ndarray:
    return np.array([list(c) for _, _, c in rows], dtype=np.float64)


def unit_rows(v: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a vector of length ``dim``, these vectors normalised)."""
    ok = np.array([x is not None and len(x) == dim for x in v], dtype=bool)
    x = np.stack(v[ok].to_numpy()).astype(np.float64) if ok.any() else np.zeros((0, dim))
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return ok, x / np.where(n > 0, n, 1.0)


def nearest_rows(v: pd.Series, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the first best row of ``matrix`` and its cosine; -1 and NaN without one.

    Cosines closer than rounding (TIE) count as equal, so the order of sums decides nothing."""
    j, s = np.full(len(v), -1, dtype=np.int32), np.full(len(v), np.nan)
    if len(matrix):
        ok, x = unit_rows(v, matrix.shape[1])
        sims = x @ matrix.T
        top = sims.max(axis=1)
        j[ok], s[ok] = np.argmax(sims >= top[:, None] - TIE, axis=1), top
    return j, s


def _unit_assigned(df: DataFrame, centroids: DataFrame, vec_col: str, order_col: str) -> DataFrame:
    """(order_col, cluster_idx, _u): each vector of the centroids' length normalised, with its nearest centroid."""
    spark = df.sparkSession
    ship_package(spark)
    rows = _collect_centroids(centroids)
    bc = spark.sparkContext.broadcast((_matrix(rows), np.array([i for i, _, _ in rows], dtype=np.int32)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, index = bc.value
        for pdf in batches:
            ok, x = unit_rows(pdf["_v"], m.shape[1])
            yield pd.DataFrame({order_col: pdf[order_col][ok], "cluster_idx": index[np.argmax(x @ m.T, axis=1)],
                                "_u": list(x)})

    source = df.select(order_col, F.col(vec_col).cast("array<double>").alias("_v"))
    schema = T.StructType([source.schema[order_col], T.StructField("cluster_idx", T.IntegerType()),
                           T.StructField("_u", T.ArrayType(T.DoubleType()))])
    return source.mapInPandas(run, schema)


def cluster_dimension(spark: SparkSession, names: Sequence[str] = CLUSTER_NAMES) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "cluster_idx int, cluster_name string")


def cluster_stats(assigned: DataFrame, names: Sequence[str] = CLUSTER_NAMES,
                  cluster_col: str = "cluster_name") -> DataFrame:
    """Per cluster: failures and share of all failures (0 when there are none).

    Clusters with no failures are listed; labels outside ``names`` (Unknown)
    are not. Counts are a partial aggregate; the k-row result is joined to the
    cluster dimension.
    """
    counts = assigned.groupBy(F.col(cluster_col).alias("cluster_name")).agg(F.count(F.lit(1)).alias("n"))
    return cluster_stats_from_counts(counts, "cluster_name", "n", names)


def cluster_stats_from_counts(counts: DataFrame, cluster_col: str = "cluster_name", count_col: str = "n",
                              names: Sequence[str] = CLUSTER_NAMES) -> DataFrame:
    """``cluster_stats`` from an already aggregated (cluster, count) table."""
    spark = counts.sparkSession
    counts = counts.select(F.col(cluster_col).alias("cluster_name"), F.col(count_col).alias("n"))
    dim = cluster_dimension(spark, names)
    j = dim.join(F.broadcast(counts), on="cluster_name", how="left") \
        .withColumn("total_failures", F.coalesce(F.col("n"), F.lit(0)).cast("bigint"))
    total = F.sum("total_failures").over(Window.partitionBy())
    return j.select(
        "cluster_idx", "cluster_name", "total_failures",
        (F.col("total_failures") / F.when(total > 0, total).otherwise(F.lit(1))).cast("double").alias("failure_rate"),
        F.lit("stable").alias("recent_trend"),
    )


def failure_rates(stats: DataFrame) -> DataFrame:
    """``(cluster_name, failure_rate)`` for curriculum weighting."""
    return stats.select("cluster_name", "failure_rate")


# ---------------------------------------------------------------------------
# Fitting
# ---------------------------------------------------------------------------
def _vec(col: Column) -> Column:
    return array_to_vector(col)


def lloyd_step(df: DataFrame, centroids: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """One Euclidean Lloyd step on unit vectors: each centroid moves to the mean
    of its assigned rows; a centroid with no rows keeps its position.

    Means come from ``Summarizer`` (partial aggregation, one row per cluster and
    partition before the shuffle).
    """
    centroids = local_centroids(centroids)
    unit = df.select(l2_normalize(vec_col).alias("_u"))
    asg = assign(unit, centroids, "_u")
    means = (asg.groupBy("cluster_idx")
             .agg(Summarizer.mean(_vec(F.col("_u"))).alias("_m"), F.count(F.lit(1)).alias("n_assigned"))
             .select("cluster_idx", vector_to_array("_m").alias("_mean"), "n_assigned"))
    return (centroids.join(F.broadcast(means), on="cluster_idx", how="left")
            .select("cluster_idx", "cluster_name",
                    F.coalesce(F.col("_mean"), F.col("centroid").cast("array<double>")).alias("centroid"),
                    F.coalesce(F.col("n_assigned"), F.lit(0)).alias("n_assigned")))


def normalize_centroids(centroids: DataFrame) -> DataFrame:
    return centroids.withColumn("centroid", l2_normalize("centroid"))


def _collect_centroids(centroids: DataFrame) -> list[tuple[int, str, list[float]]]:
    # k x dim values, bounded by MAX_K (checked by callers)
    return sorted((int(r[0]), r[1], list(r[2])) for r in
                  centroids.select("cluster_idx", "cluster_name", F.col("centroid").cast("array<double>")).collect())


def centroids_frame(spark: SparkSession, rows: Sequence[tuple[int, str, Sequence[float]]]) -> DataFrame:
    return spark.createDataFrame([(int(i), n, [float(x) for x in c]) for i, n, c in rows], CENTROIDS)


def fit(df: DataFrame, centroids: DataFrame | None = None, k: int = 6, names: Sequence[str] = CLUSTER_NAMES,
        vec_col: str = "embedding", order_col: str = "seq", min_samples: int = 20, max_iter: int = 300,
        tol: float = 1e-4, n_init: int = 10, seed: int = 42) -> DataFrame:
    """k-means on unit vectors, returning unit-normalised centroids.

    * fewer than ``min_samples`` rows: heuristic start (evenly spaced rows, or
      rows plus seeded random unit vectors);
    * given centroids: Lloyd iterations from them (Euclidean), until the total
      squared centre shift is within ``tol`` x mean feature variance;
    * no centroids: Spark ML k-means (k-means|| start), best of ``n_init`` seeds.
    Rows without a vector (null, or with a null element) move no centroid.
    Each iteration is one distributed aggregate over the unit vectors, packed and
    persisted once; only k x dim numbers return to the driver between iterations.
    """
    spark = df.sparkSession
    names = list(names)[:k] + [f"cluster_{i}" for i in range(len(names), k)]
    whole = whole_vector(F.col(vec_col))
    n, n_whole = df.agg(F.count(F.lit(1)), F.count(F.when(whole, 1))).first()
    df = df.where(whole)
    if n < min_samples or not n_whole:
        return heuristic_init(df, k, names, vec_col, order_col, seed)
    unit = df.select(l2_normalize(vec_col).alias("_u")).where(F.size("_u") > 0)
    cur = _collect_centroids(centroids) if centroids is not None and _check_k(centroids) else []
    if not cur:
        from pyspark.ml.clustering import KMeans
        feats = unit.select(_vec(F.col("_u")).alias("features")).persist()
        best, best_cost = None, math.inf
        for i in range(max(1, n_init)):
            model = KMeans(k=k, maxIter=max_iter, tol=tol, seed=seed + i, initMode="k-means||").fit(feats)
            cost = model.summary.trainingCost
            if cost < best_cost:
                best, best_cost = model, cost
        feats.unpersist()
        centres = [[float(x) for x in c] for c in best.clusterCenters()]
        if len(centres) < k:  # fewer distinct rows than clusters
            pad = np.random.default_rng(seed).standard_normal((k - len(centres), len(centres[0])))
            centres += [[float(x) for x in p] for p in pad]
        return normalize_centroids(centroids_frame(spark, [(i, names[i], c) for i, c in enumerate(centres)]))
    fits = unit.where(F.size("_u") == len(cur[0][2]))  # one group, or none
    var = fits.groupBy(F.size("_u")).agg(Summarizer.variance(_vec(F.col("_u"))).alias("v")).first()
    tol_abs = float(np.mean(var["v"].toArray())) * tol if var is not None else 0.0
    packed = _packed_units(df, vec_col, len(cur[0][2])).persist()
    try:
        for _ in range(max_iter):
            nxt = _lloyd_iteration(packed, cur)
            shift = float(np.sum((_matrix(cur) - _matrix(nxt)) ** 2))
            cur = nxt
            if shift <= tol_abs:
                break
    finally:
        packed.unpersist()
    return normalize_centroids(centroids_frame(spark, cur))


def whole_vector(v: Column) -> Column:
    """Whether a row has a vector: not null, and no null among its elements."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull()), F.lit(False))


def _packed_units(df: DataFrame, vec_col: str, dim: int) -> DataFrame:
    """(u): the vectors of length ``dim`` normalised, the doubles of up to PACK_ROWS as one binary value.

    A pass over blocks costs a small part of a pass over arrays, which go to Python element by element."""
    ship_package(df.sparkSession)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            _, x = unit_rows(pdf["_v"], dim)
            yield pd.DataFrame({"u": pd.Series([x[i:i + PACK_ROWS].tobytes() for i in range(0, len(x), PACK_ROWS)],
                                               dtype=object)})

    return df.select(F.col(vec_col).cast("array<double>").alias("_v")).mapInPandas(pack, "u binary")


def _lloyd_iteration(packed: DataFrame, cur: list[tuple[int, str, list[float]]]):
    """One Lloyd step as a single aggregate job: each partition sends one (sum, count) row for
    each cluster it has rows of; k rows return to the driver."""
    spark = packed.sparkSession
    bc = spark.sparkContext.broadcast(_matrix(cur))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = bc.value
        sums, counts = np.zeros(m.shape), np.zeros(len(m), dtype=np.int64)
        for batch in batches:
            vectors = np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, m.shape[1])
            for i in range(0, len(vectors), STEP_ROWS):
                x = vectors[i:i + STEP_ROWS]
                j = np.argmax(x @ m.T, axis=1)
                order = np.argsort(j, kind="stable")
                found, first = np.unique(j[order], return_index=True)
                sums[found] += np.add.reduceat(x[order], first, axis=0)
                counts += np.bincount(j, minlength=len(m))
        has = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(has, pa.int32()), pa.array(list(sums[has]), pa.list_(pa.float64())), pa.array(counts[has], pa.int64())],
            ["j", "s", "n"])

    rows = (packed.mapInArrow(partial, "j int, s array<double>, n bigint").groupBy("j")
            .agg(Summarizer.sum(_vec(F.col("s"))).alias("s"), F.sum("n").alias("n"))
            .select("j", vector_to_array("s").alias("s"), "n").collect())  # k rows
    bc.destroy()
    means = {r["j"]: [x / r["n"] for x in r["s"]] for r in rows}
    return [(i, name, means.get(j, c)) for j, (i, name, c) in enumerate(cur)]


def heuristic_init(df: DataFrame, k: int, names: Sequence[str], vec_col: str = "embedding",
                   order_col: str = "seq", seed: int = 42) -> DataFrame:
    """Start centroids from a small set (callers check n < min_samples).

    n >= k: rows at floor(linspace(0, n-1, k)) in ``order_col`` order; else all
    rows followed by seeded standard-normal vectors (numpy ``default_rng(seed)``),
    everything unit-normalised.
    """
    spark = df.sparkSession
    w = Window.orderBy(F.col(order_col).asc())  # single partition: the set is below min_samples
    pos = df.select(l2_normalize(vec_col).alias("centroid"), (F.row_number().over(w) - 1).alias("pos"))
    n = pos.count()
    if n >= k:
        picks = evenly_spaced_positions(spark, n, k)
        chosen = picks.join(pos, on="pos", how="inner").select("cluster_idx", "centroid")
        dim_names = cluster_dimension(spark, list(names)[:k])
        return dim_names.join(chosen, on="cluster_idx").select("cluster_idx", "cluster_name", "centroid")
    rows = [(int(r["pos"]), list(r["centroid"])) for r in pos.collect()]  # n < k rows
    dim = len(rows[0][1]) if rows else 0
    pad = np.random.default_rng(seed).standard_normal((k - n, dim)).astype(np.float32).astype(np.float64)
    pad = pad / np.maximum(np.linalg.norm(pad, axis=1, keepdims=True), 1e-300)
    vecs = [c for _, c in sorted(rows)] + [list(p) for p in pad]
    return normalize_centroids(centroids_frame(spark, [(i, names[i], v) for i, v in enumerate(vecs)]))


def evenly_spaced_positions(spark: SparkSession, n: int, k: int) -> DataFrame:
    """``(cluster_idx, pos)`` with pos = int(i * ((n - 1) / (k - 1))) in double, the last
    index pinned to n - 1 (floor of linspace); k = 1 -> 0."""
    idx = spark.range(k).select(F.col("id").cast("int").alias("cluster_idx"))
    if k == 1:
        return idx.select("cluster_idx", F.lit(0).cast("bigint").alias("pos"))
    step = F.lit(float(n - 1)) / F.lit(float(k - 1))
    pos = F.when(F.col("cluster_idx") == k - 1, F.lit(n - 1)) \
        .otherwise(F.floor(F.col("cluster_idx").cast("double") * step))
    return idx.select("cluster_idx", pos.cast("bigint").alias("pos"))


# ---------------------------------------------------------------------------
# Incremental update (exponential moving average)
# ---------------------------------------------------------------------------
def ema_update(df: DataFrame, centroids: DataFrame | None, alpha: float = 0.1, vec_col: str = "embedding",
               order_col: str = "seq") -> DataFrame:
    """Mini-batch EMA update ('minibatch' mode): centroids frozen for the batch.

    Each row is assigned to its nearest frozen centroid; a cluster with m rows
    becomes (1-a)^m c + sum_r a (1-a)^r x_r over all its rows, with r the recency rank
    (0 = latest), then every centroid is unit-normalised. Ranks are split prefix sums,
    and the weighted sum is a partial aggregate, so a hot cluster makes no hot task.
    Without centroids they are fitted on the batch.
    """
    if centroids is None:
        return fit(df, None, vec_col=vec_col, order_col=order_col).withColumn("n_assigned", F.lit(0).cast("bigint"))
    centroids = local_centroids(centroids)
    asg = _unit_assigned(df, centroids, vec_col, order_col)
    m = asg.groupBy("cluster_idx").agg(F.count(F.lit(1)).alias("m"))
    counted = running_count(asg, "cluster_idx", order_col, F.lit(True), "_n")
    sums = (counted.join(F.broadcast(m), "cluster_idx")
            .withColumn("_w", F.lit(alpha) * F.pow(F.lit(1.0 - alpha), F.col("m") - F.col("_n")))
            .groupBy("cluster_idx").agg(Summarizer.sum(_vec(F.col("_u")), F.col("_w")).alias("_s"))
            .select("cluster_idx", vector_to_array("_s").alias("_sum")))
    joined = (centroids.join(F.broadcast(m), on="cluster_idx", how="left")
              .join(F.broadcast(sums), on="cluster_idx", how="left")
              .withColumn("m", F.coalesce(F.col("m"), F.lit(0))))
    decay = F.pow(F.lit(1.0 - alpha), F.col("m").cast("double"))
    moved = F.when(F.col("_sum").isNull(), F.col("centroid").cast("array<double>")).otherwise(
        F.zip_with(F.col("centroid").cast("array<double>"), F.col("_sum"), lambda c, s: decay * c + s))
    return joined.select("cluster_idx", "cluster_name", l2_normalize(moved).alias("centroid"),
                         F.col("m").alias("n_assigned"))


def ordered_ema_update(df: DataFrame, centroids: DataFrame, alpha: float = 0.1, vec_col: str = "embedding",
                       order_col: str = "seq", key_cols: Sequence[str] = ()) -> DataFrame:
    """Row-by-row EMA ('ordered' mode): each row is assigned against centroids
    already moved by the rows before it; all centroids are normalised at the end.

    Sequential by definition, so it is one fold per key (``key_cols``, e.g. a
    run or benchmark). Rows stream through the fold in ``order_col`` order in
    Arrow batches with only the k x dim state in memory; nothing is collected.
    """
    _check_k(centroids)
    cent = _collect_centroids(centroids)
    spark = df.sparkSession
    ship_package(spark)
    bc = spark.sparkContext.broadcast([(i, n, np.array(c, dtype=np.float64)) for i, n, c in cent])
    keys = list(key_cols)
    key_fields = [df.schema[kc] for kc in keys]
    out_schema = T.StructType(key_fields + [T.StructField("cluster_idx", T.IntegerType()),
                                            T.StructField("cluster_name", T.StringType()),
                                            T.StructField("centroid", T.ArrayType(T.DoubleType())),
                                            T.StructField("n_assigned", T.LongType())])

    def fold(it):
        states: dict = {}
        for pdf in it:
            key_vals = [pdf[kc].to_numpy() for kc in keys]
            vecs = pdf["vec_"].to_numpy()
            for r in range(len(pdf)):
                key = tuple(kv[r] for kv in key_vals)
                st = states.get(key)
                if st is None:
                    st = states[key] = (np.stack([c for _, _, c in bc.value]).astype(np.float64),
                                        np.zeros(len(bc.value), dtype=np.int64))
                x = np.asarray(vecs[r], dtype=np.float64)
                nx = np.linalg.norm(x)
                if nx > 0:
                    x = x / nx
                mat = st[0]
                j = int(np.argmax(mat @ x))
                mat[j] = (1 - alpha) * mat[j] + alpha * x
                st[1][j] += 1
        rows = []
        for key, (cs, counts) in states.items():
            for (i, name, _), c, cnt in zip(bc.value, cs, counts.tolist()):
                nc = np.linalg.norm(c)
                rows.append(list(key) + [i, name, list(c / nc) if nc > 0 else list(c), cnt])
        yield pd.DataFrame(rows, columns=[f.name for f in out_schema.fields])

    if not keys:
        raise ValueError("ordered mode folds one centroid set per key: pass key_cols (e.g. a run column); "
                         "use ema_update for the distributed update")
    src = df.select(*keys, F.col(order_col), F.col(vec_col).cast("array<double>").alias("vec_"))
    return src.repartition(*keys).sortWithinPartitions(*keys, order_col).mapInPandas(fold, out_schema)


# ---------------------------------------------------------------------------
# Embedding (pluggable encoder)
# ---------------------------------------------------------------------------
def hashing_encoder(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = 1024,
                    with_prefix: bool = True) -> DataFrame:
    """Default JVM encoder: tokens -> hashed term counts -> unit vector (no model files)."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    src = df.withColumn("_txt", embed_input(text_col) if with_prefix else F.col(text_col))
    tok = RegexTokenizer(inputCol="_txt", outputCol="_tok", pattern=r"\W+")
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    nz = Normalizer(inputCol="_tf", outputCol="_nv", p=2.0)
    out = nz.transform(tf.transform(tok.transform(src)))
    return out.withColumn(out_col, vector_to_array("_nv", dtype="float32")).drop("_txt", "_tok", "_tf", "_nv")


#: Terms of ``term_encoder``: runs of ASCII letters, digits and underscores, lower-cased.
TERM = r"[A-Za-z0-9_]+"
TERM_MEMO = 200_000  # terms kept with their hash by a Python worker


def term_place(term: str, dim: int) -> tuple[int, int]:
    """(place, sign) of a term: the first six hex digits of its md5 modulo ``dim``, + if the seventh is below 8."""
    digest = hashlib.md5(term.encode(), usedforsecurity=False).hexdigest()
    return int(digest[:6], 16) % dim, 1 if digest[6] < "8" else -1


def term_encoder(df: DataFrame, text_col: str, out_col: str = "embedding", dim: int = 256,
                 with_prefix: bool = True) -> DataFrame:
    """Encoder defined by arithmetic alone: signed counts of md5-hashed terms, as a unit vector.

    Equal in any engine that has md5. A text without terms gets the zero vector, a null text a
    null one. A batch's counts are one bincount; each worker hashes a term once.
    """
    from pyspark.sql.functions import pandas_udf
    ship_package(df.sparkSession)

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find, memo = re.compile(TERM).findall, {}
        for texts in batches:
            if len(memo) > TERM_MEMO:
                memo = {}
            cells, signs = [], []
            for row, text in enumerate(texts):
                for term in find(text) if text is not None else ():
                    at = memo.get(term)
                    if at is None:
                        at = memo[term] = term_place(term.lower(), dim)
                    cells.append(row * dim + at[0])
                    signs.append(at[1])
            sums = np.bincount(np.array(cells, np.int64), np.array(signs, np.float64), len(texts) * dim).reshape(-1, dim)
            norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            unit = sums / np.where(norm > 0, norm, 1)
            yield pd.Series([None if t is None else v for t, v in zip(texts, unit, strict=True)], dtype=object)

    return df.withColumn(out_col, enc(embed_input(text_col) if with_prefix else F.col(text_col)))


_MODEL_CACHE: dict = {}


def model_encoder(df: DataFrame, text_col: str, load_model: Callable[[], Callable], out_col: str = "embedding",
                  with_prefix: bool = True) -> DataFrame:
    """User-supplied encoder in an iterator Pandas UDF: the model loads once per
    Python worker and encodes Arrow batches (size via
    ``spark.sql.execution.arrow.maxRecordsPerBatch``); outputs are unit-normalised."""
    from pyspark.sql.functions import pandas_udf
    ship_package(df.sparkSession)
    key = uuid.uuid4().hex  # a worker serves many calls, whose objects may share an id

    @pandas_udf(T.ArrayType(T.FloatType()))
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _MODEL_CACHE:
            _MODEL_CACHE[key] = load_model()
        model = _MODEL_CACHE[key]
        for texts in batches:
            m = np.asarray(model(texts.tolist()), dtype=np.float32)
            nrm = np.linalg.norm(m, axis=1, keepdims=True)
            m = np.where(nrm > 0, m / np.where(nrm > 0, nrm, 1), m)
            yield pd.Series(list(m))

    src = embed_input(text_col) if with_prefix else F.col(text_col)
    return df.withColumn(out_col, enc(src))


def anchored_centroids(spark: SparkSession, k: int = 6, names: Sequence[str] = CLUSTER_NAMES,
                       encoder: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Centroids from one exemplar text per cluster (cut or padded to k), encoded and normalised."""
    texts = ANCHOR_EXEMPLARS[:k] + [ANCHOR_PAD] * max(0, k - len(ANCHOR_EXEMPLARS))
    names = list(names)[:k] + [f"cluster_{i}" for i in range(len(names), k)]
    ex = spark.createDataFrame([(i, names[i], t) for i, t in enumerate(texts)],
                               "cluster_idx int, cluster_name string, text string")
    enc = encoder or (lambda d: hashing_encoder(d, "text"))
    return enc(ex).select("cluster_idx", "cluster_name", l2_normalize("embedding").alias("centroid"))
