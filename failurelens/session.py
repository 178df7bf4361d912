"""Session helpers: one place for the configs every job relies on."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # size shuffle partitions by bytes (advisory size), not by core count
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # duplicate JSON keys resolve last-wins, like Python's json module
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def get_session(master: str | None = None, app: str = "failurelens",
                shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster the master and most sizes come from spark-submit; here we only
    fill in what is unset.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in extra.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that ``spark.checkpoint.dir`` names; None if it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate data, under ``spark.checkpoint.dir``.

    Only a local session, where all tasks share the machine, may leave the setting out
    and gets a temporary folder; on a cluster that would not be shared, so it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = shared_folder(spark)
        if not named and not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="failurelens-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def small_frame(df, max_rows: int, what: str = "table"):
    """Materialise a table with a proven size bound as a local relation.

    The bound is checked with ``limit(max_rows + 1)`` (stops early on a large
    input); the rows then live in the plan as a literal relation, so every
    later use broadcasts them without recomputing their (possibly large) lineage.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} exceeds its bound of {max_rows} rows")
    return df.sparkSession.createDataFrame(rows, df.schema)


_SHIPPED: set = set()


def ship_package(spark) -> None:
    """Make ``failurelens`` importable on executors (once per SparkContext).

    Operators that run Python on executors (Arrow-batched numpy steps) pickle
    references to this package; the package is zipped from its installed
    location and distributed with ``addPyFile``.
    """
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="failurelens-pkg-"), "failurelens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
