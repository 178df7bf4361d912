"""Failure store: upserts, recency queries, counts and similarity lookups.

Layout: plain Parquet partitioned by ``batch_id`` and ``failure_cluster``; a batch
replaces only its own partitions. A record's current row is its latest one, so a
filter on the cluster comes after that choice and does not prune directories.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from failurelens.functions.text import canonical_cluster
from failurelens.functions.vectors import cosine_eps, literal_vector
from failurelens.schemas import FAILURE_RECORD



def clean_records(df: DataFrame) -> DataFrame:
    """Empty embedding -> NULL, empty repair trace -> NULL, labels onto the cluster domain."""
    out = df
    if "embedding" in df.columns:
        out = out.withColumn("embedding", F.when(F.size("embedding") > 0, F.col("embedding")))
    if "repair_trace" in df.columns:
        rt = F.col("repair_trace")
        empty = rt.isNull() | ((F.coalesce(F.size(rt["steps"]), F.lit(0)) <= 0)
                               & (F.coalesce(rt["repaired_code"], F.lit("")) == "")
                               & (F.coalesce(rt["repair_reasoning"], F.lit("")) == ""))
        out = out.withColumn("repair_trace", F.when(~empty, rt))
    if "failure_cluster" in df.columns:
        out = out.withColumn("failure_cluster", canonical_cluster("failure_cluster", "strict"))
    return out


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep, per key, the row with the greatest ``order`` tuple (latest wins).

    Written as ``max_by`` in a hash aggregate, so each input partition first
    reduces a key to one row (map-side combine): a key holding a third of all
    rows still ships one row per partition, not its whole history.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    ordc = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    packed = F.max_by(F.struct(*rest), ordc).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, "_row.*")


def upsert(current: DataFrame | None, batch: DataFrame, key: str = "record_id",
           seq_col: str = "seq") -> DataFrame:
    """INSERT OR REPLACE: rows of ``batch`` replace stored rows with the same key;
    within the batch a later ``seq`` wins."""
    batch = clean_records(batch)
    if seq_col not in batch.columns:
        batch = batch.withColumn(seq_col, F.monotonically_increasing_id())
    staged = batch.withColumn("_src", F.lit(1))
    if current is not None:
        cur = current.withColumn("_src", F.lit(0))
        if seq_col not in cur.columns:
            cur = cur.withColumn(seq_col, F.lit(0).cast("bigint"))
        staged = cur.unionByName(staged, allowMissingColumns=True)
    return latest_per_key(staged, [key], ["_src", seq_col]).drop("_src")


def by_cluster(store: DataFrame, cluster: str, limit: int = 100) -> DataFrame:
    """Most recent failures of one cluster."""
    return recent(store.where(F.col("failure_cluster") == cluster), limit)


def recent(store: DataFrame, limit: int = 1000) -> DataFrame:
    """Most recent failures overall; ties broken by record_id."""
    from failurelens.operators.topk import top_k
    return top_k(store, limit, "created_at", descending=True, tie_cols=[F.col("record_id").asc()])


def recent_per_cluster(store: DataFrame, limit: int = 100) -> DataFrame:
    """Top ``limit`` recent failures of every cluster in one pass.

    ``row_number() <= limit`` plans as a partial WindowGroupLimit before the
    shuffle, so each partition ships at most ``limit`` rows per cluster.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("failure_cluster").orderBy(F.col("created_at").desc(), F.col("record_id").asc())
    return store.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def count_by_cluster(store: DataFrame) -> DataFrame:
    return store.groupBy("failure_cluster").agg(F.count(F.lit(1)).alias("cnt"))


def total_count(store: DataFrame) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("total"))


def all_embeddings(store: DataFrame) -> DataFrame:
    """Stored embeddings (non-null only), left distributed."""
    return store.where(F.col("embedding").isNotNull()).select("record_id", "embedding")


def search_similar(store: DataFrame, query: Sequence[float], top_k: int = 5,
                   id_col: str = "record_id", vec_col: str = "embedding") -> DataFrame:
    """Exact top-k by cosine (+1e-8 on each norm) for one query vector.

    Ranks on (id, embedding) only, then joins the k winners back to the full
    rows, so the sort never carries wide columns.
    """
    ranked = (store.where(F.col(vec_col).isNotNull())
              .select(id_col, cosine_eps(vec_col, literal_vector(query)).alias("similarity"))
              .orderBy(F.col("similarity").desc(), F.col(id_col).asc()).limit(top_k))
    return ranked.join(store, on=id_col, how="inner").orderBy(F.col("similarity").desc(), F.col(id_col).asc())


# ---------------------------------------------------------------------------
# Plain partitioned Parquet persistence
# ---------------------------------------------------------------------------
STORED = T.StructType([f for f in FAILURE_RECORD.fields if f.name != "failure_cluster"]
                      + [T.StructField("seq", T.LongType()), T.StructField("batch_id", T.LongType()),
                         T.StructField("failure_cluster", T.StringType())])


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _replace_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Write ``df``, replacing only the partitions that it holds."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path))


def write_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """Store ``batch`` under its id; the same id written again replaces only itself."""
    rows = clean_records(batch)
    if "seq" not in rows.columns:
        rows = rows.withColumn("seq", F.monotonically_increasing_id())
    rows = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    _replace_partitions(rows.select(*[f.name for f in STORED.fields if f.name in rows.columns]), path,
                        "batch_id", "failure_cluster")


def read_batches(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """All stored rows, of batches up to ``upto``; an absent path has none."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], STORED)
    rows = spark.read.schema(STORED).parquet(path)
    return rows if upto is None else rows.where(F.col("batch_id") <= upto)


def read_store(spark: SparkSession, path: str, upto: int | None = None,
               columns: Sequence[str] | None = None) -> DataFrame:
    """The current rows: per record the latest batch, in it the latest ``seq``.

    ``columns`` limits what is read and aggregated to these, the key and the order.
    """
    rows = read_batches(spark, path, upto)
    if columns is not None:
        rows = rows.select(*dict.fromkeys(["record_id", "batch_id", "seq", *columns]))
    return latest_per_key(rows, ["record_id"], ["batch_id", "seq"]).drop("batch_id")


def write_state(df: DataFrame, path: str, version: int) -> None:
    """A small table's version N, written from version N - 1 into one of two slots.

    A replayed step rewrites its own slot from the other one, and old versions go."""
    rows = df.withColumn("version", F.lit(version).cast("bigint")).withColumn("slot", F.lit(version % 2))
    _replace_partitions(rows, path, "slot")


def read_state(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> DataFrame | None:
    """Version ``version`` (the newest by default); None if nothing was ever written."""
    if not path_exists(spark, path):
        return None
    held = T.StructType([*schema.fields, T.StructField("version", T.LongType()), T.StructField("slot", T.IntegerType())])
    rows = spark.read.schema(held).parquet(path)
    wanted = F.lit(version) if version is not None else rows.select(F.max("version")).scalar()
    rows = rows.where(F.col("version") == wanted)
    if version is not None:
        rows = rows.where(F.col("slot") == version % 2)
    return rows.drop("version", "slot")


def claim(spark: SparkSession, path: str, owner: str) -> None:
    """Bind an output folder to the checkpoint that writes it; another one's outputs are never overwritten."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(path, "_owner")
    fs = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(mark):
        out = fs.create(mark, False)
        out.writeUTF(owner)
        out.close()
        return
    held = fs.open(mark)
    found = held.readUTF()
    held.close()
    if found != owner:
        raise ValueError(f"{path} is written by the stream with checkpoint {found}, not {owner}")
