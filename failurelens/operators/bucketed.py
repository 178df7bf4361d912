"""The failure store as a bucketed table: the current rows, laid out by the hash of ``record_id``.

An upsert joins the stored buckets with the batch's: only the batch is shuffled, into as many
partitions as there are buckets, and each task merges one bucket and writes it anew. Reads
need no merge: the table has one row for each record. Point lookups read one bucket.

Two slots hold versions in turn: version N is written to slot N % 2 from version N - 1, so a
replayed batch rewrites its own slot, and old versions go. Tables have a name and a folder;
``attach`` makes a folder known to a session whose catalog does not have it.

Defined results: as ``store.upsert``: later rows of a batch win over earlier ones (by ``seq``), the
batch over what is stored; an empty batch leaves the rows as they are.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from failurelens.operators.store import clean_records, latest_per_key, path_exists

BUCKETS = 64


def _slot(name: str, path: str, version: int) -> tuple[str, str]:
    return f"{name}_{version % 2}", os.path.join(path, f"slot={version % 2}")


def _write(rows: DataFrame, table: str, path: str, key: str, buckets: int) -> None:
    (rows.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path)
     .mode("overwrite").saveAsTable(table))


def attach(spark: SparkSession, name: str, path: str, version: int, schema: T.StructType, key: str = "record_id",
           buckets: int = BUCKETS) -> None:
    """Make version ``version`` known under ``name``, if the session's catalog lacks it."""
    table, folder = _slot(name, path, version)
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
                  f"INTO {buckets} BUCKETS LOCATION '{folder}'")


def current(spark: SparkSession, name: str, path: str, version: int) -> DataFrame | None:
    """The rows of a version; None before the first."""
    table, folder = _slot(name, path, version)
    if version < 1 or not path_exists(spark, folder):
        return None
    return spark.table(table)


def merged(stored: DataFrame | None, batch: DataFrame, key: str = "record_id", seq_col: str = "seq",
           buckets: int = BUCKETS) -> DataFrame:
    """``stored`` (one row for each key) with the batch's latest rows in place of its own.

    The columns are the stored ones; with a bucketed ``stored`` only the batch is shuffled.
    """
    rows = clean_records(batch)
    if seq_col not in rows.columns:
        rows = rows.withColumn(seq_col, F.monotonically_increasing_id())
    rows = latest_per_key(rows, [key], [seq_col])
    if stored is None:
        return rows.repartition(buckets, key)
    new = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c)
                        for c in stored.columns])
    new = new.repartition(buckets, key).select(F.col(key).alias("_key"), F.struct(*stored.columns).alias("_new"))
    both = stored.join(new, stored[key] == F.col("_key"), "full_outer")
    return both.select(*[F.when(F.col("_key").isNotNull(), F.col("_new")[c]).otherwise(stored[c]).alias(c)
                         for c in stored.columns])


def upsert(spark: SparkSession, name: str, path: str, batch: DataFrame, version: int, key: str = "record_id",
           seq_col: str = "seq", buckets: int = BUCKETS) -> DataFrame:
    """Write version ``version`` (1, 2, ...) from the one before and ``batch``; the new rows."""
    rows = merged(current(spark, name, path, version - 1), batch, key, seq_col, buckets)
    table, folder = _slot(name, path, version)
    _write(rows, table, folder, key, buckets)
    return spark.table(table)
