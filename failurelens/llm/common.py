"""Helpers that the corpus operators share: reading, splits, batching, shared tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failurelens.session import scratch_path, ship_package

#: Documents are taken through Python in slices of about this many text bytes, so a
#: worker's memory does not depend on the size of an Arrow batch.
SLICE_BYTES = 2 << 20

#: An Arrow batch of rows goes to Python with about this many bytes. It is held whole by the
#: executor, outside its heap, and again by the worker, for each running task.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``, equals ``remainder``; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the folder named by ``spark.checkpoint.dir`` and read it back.

    It cuts the lineage: a lost executor costs only the tasks it was running.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Executors get the package's code once per application, and rows in batches of BATCH_BYTES
    unless the session sets a size of its own."""
    ship_package(spark)
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_slices(batch: pa.RecordBatch, column: str = "text",
                size: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) of consecutive row ranges holding about ``size`` bytes; null is empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    start, held, used = 0, [], 0
    for i, value in enumerate(texts):
        raw = value.as_buffer()
        raw = b"" if raw is None else raw.to_pybytes()
        held.append(raw)
        used += len(raw)
        if used >= size:
            yield start, held
            start, held, used = i + 1, [], 0
    if held:
        yield start, held


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """A row's identity: its id (null last) and a hash of its text, so repeated ids stay apart."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("doc_key"),
            F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key")]
