"""Exact top-k cosine search for many query vectors at once.

Plan: the query set is small and bounded (checked), so it is broadcast; the
store stays where it is. Each store partition scores its rows against all
queries in Arrow batches (one matrix product per batch), keeps a running top-k
per query over its batches and emits it at its end: at most partitions x queries
x k rows. A final ``row_number() <= k`` per query merges the
local winners (partial WindowGroupLimit before the shuffle).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from failurelens.operators.buffer import arrival_numbers
from failurelens.session import ship_package

MAX_BROADCAST_QUERIES = 4096
EPS = 1e-8


MAX_BLOCK_CELLS = 8_000_000  # similarity cells scored at once (~64 MB of doubles)


def _local_top_k(qids: np.ndarray, qmat: np.ndarray, k: int, block_cells: int = MAX_BLOCK_CELLS):
    """The partition's top ``k`` rows of each query, found in a running way over its batches."""

    def best(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts, ignore_index=True).sort_values(["q", "similarity", "id"], ascending=[True, False, True])
        return rows.groupby("q", sort=False).head(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n_held, floor = 0, np.full(len(qmat), -np.inf)
        for pdf in batches:
            if pdf.empty:
                continue
            emb = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            emb = emb / (np.linalg.norm(emb, axis=1, keepdims=True) + EPS)
            ids = pdf["id"].to_numpy()
            n = emb.shape[0]
            # score the batch against blocks of queries so memory stays bounded
            step = max(1, block_cells // max(n, 1))
            for q0 in range(0, qmat.shape[0], step):
                sims = emb @ qmat[q0:q0 + step].T  # rows x block of queries
                cut = floor[q0:q0 + step]
                if n > k:  # ties at the k-th place stay for the exact order by id
                    cut = np.maximum(cut, np.partition(sims, n - k, axis=0)[n - k])
                rows, cols = np.nonzero(sims >= cut[None, :])
                held.append(pd.DataFrame({"q": q0 + cols, "id": ids[rows], "similarity": sims[rows, cols]}))
                n_held += len(rows)
            if n_held > 4 * k * len(qmat):
                held = [best(held)]
                n_held = len(held[0])
                full = held[0].groupby("q")["similarity"].agg(["size", "min"])
                full = full[full["size"] >= k]
                floor[full.index.to_numpy()] = full["min"].to_numpy()
        if held:
            out = best(held)
            yield pd.DataFrame({"query_id": qids[out["q"].to_numpy()], "id": out["id"], "similarity": out["similarity"]})
    return run


def top_k_similar(store: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "record_id",
                  vec_col: str = "embedding", query_id_col: str = "query_id",
                  query_vec_col: str = "query_vec", max_broadcast: int = MAX_BROADCAST_QUERIES,
                  block_cells: int = MAX_BLOCK_CELLS) -> DataFrame:
    """Top ``k`` store rows per query by cosine with 1e-8 on each norm.

    Result: ``(query_id, <id_col>, similarity, rank)``, ties broken by id.
    Query sets above ``max_broadcast`` are taken in blocks, each with a scan of the store;
    query ids that repeat with the same vector count once.
    """
    spark = store.sparkSession
    ship_package(spark)
    queries = queries.select(query_id_col, query_vec_col).distinct()
    nq = queries.count()
    if nq == 0:
        schema = T.StructType([T.StructField(query_id_col, queries.schema[query_id_col].dataType),
                               T.StructField(id_col, store.schema[id_col].dataType),
                               T.StructField("similarity", T.DoubleType()),
                               T.StructField("rank", T.IntegerType())])
        return spark.createDataFrame([], schema)
    if nq > max_broadcast:
        # blocks by arrival, whatever the ids are; each block is one scan of the store
        n_blocks = -(-nq // max_broadcast)
        numbered = arrival_numbers(queries, "_at").withColumn("_block", F.col("_at") % n_blocks)
        parts = [top_k_similar(store, numbered.where(F.col("_block") == i).drop("_at", "_block"), k, id_col, vec_col,
                               query_id_col, query_vec_col, max_broadcast, block_cells) for i in range(n_blocks)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    rows = queries.select(query_id_col, F.col(query_vec_col).cast("array<double>")).collect()  # bounded: nq <= max
    qids = np.array([r[0] for r in rows])
    qmat = np.array([r[1] for r in rows], dtype=np.float64)
    qmat = qmat / (np.linalg.norm(qmat, axis=1, keepdims=True) + EPS)
    bq = spark.sparkContext.broadcast((qids, qmat))

    id_type = store.schema[id_col].dataType
    qid_type = queries.schema[query_id_col].dataType
    schema = T.StructType([T.StructField("query_id", qid_type), T.StructField("id", id_type),
                           T.StructField("similarity", T.DoubleType())])

    def run(batches):
        q_ids, q_mat = bq.value
        yield from _local_top_k(q_ids, q_mat, k, block_cells)(batches)

    local = (store.where(F.col(vec_col).isNotNull())
             .select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
             .mapInPandas(run, schema))
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("id").asc())
    return (local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.col("query_id").alias(query_id_col), F.col("id").alias(id_col), "similarity", "rank"))
