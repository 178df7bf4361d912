"""Replay buffer and curriculum sampling.

The buffer is a DataFrame of training examples with an explicit arrival
sequence ``seq``. Capacity, sampling and weighting are declarative: a top-k by
``seq`` (TakeOrderedAndProject), a top-n by a hash-derived random key, and a
broadcast join against the (cluster -> failure rate) table, which has at most
one row per cluster label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failurelens.functions.text import chat_messages
from failurelens.operators.topk import top_k

TWO_POW_48_PLUS_1 = float(2 ** 48 + 1)


def hash_uniform(key, seed: int) -> Column:
    """Deterministic u in (0, 1) from md5(key || '|' || seed): first 12 hex digits, +1, / (2^48 + 1).

    Stable across partitionings and reproducible in SQL engines.
    """
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(k.cast("string"), F.lit("|"), F.lit(str(seed))))
    return (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + F.lit(1.0)) / F.lit(TWO_POW_48_PLUS_1)


def fifo(buffer: DataFrame, capacity: int, seq_col: str = "seq", key_cols: tuple[str, ...] = ()) -> DataFrame:
    """Keep the newest ``capacity`` rows by arrival (optionally per key).

    Global: a bounded top-k (each partition keeps its own top ``capacity``, one
    merge of at most partitions x capacity rows). Per key: ``row_number() <=
    capacity``, planned with a partial WindowGroupLimit before the shuffle.
    """
    if key_cols:
        w = Window.partitionBy(*key_cols).orderBy(F.col(seq_col).desc())
        return buffer.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= capacity).drop("_rn")
    return top_k(buffer, capacity, seq_col, descending=True)


def arrival_numbers(rows: DataFrame, into: str) -> DataFrame:
    """Number rows 0, 1, 2... in partition order, the same on every run over the same input."""
    local = F.monotonically_increasing_id()  # partition * 2**33 + place
    placed = rows.withColumn("_id", local)
    part = F.shiftright("_id", 33)
    counts = placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (placed.withColumn("_p", part).join(offsets, "_p")
            .withColumn(into, F.col("_off") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_id", "_p", "_off"))


def append(buffer: DataFrame | None, examples: DataFrame, capacity: int | None = None,
           seq_col: str = "seq") -> DataFrame:
    """Add examples after the current newest row, then enforce capacity.

    Examples without ``seq`` are numbered after the buffer's maximum in their incoming
    order, densely: rows are counted per partition, and each gets the count of the
    partitions before its own plus its place. Their order must be that of the input's
    files or rows; ``examples`` is read twice.
    """
    if seq_col not in examples.columns:
        base = F.lit(0).cast("bigint") if buffer is None else \
            F.coalesce(buffer.select(F.max(seq_col)).scalar(), F.lit(-1)).cast("bigint") + 1
        examples = arrival_numbers(examples, seq_col).withColumn(seq_col, base + F.col(seq_col))
    out = examples if buffer is None else buffer.unionByName(examples, allowMissingColumns=True)
    return fifo(out, capacity, seq_col) if capacity is not None else out


def distribution(buffer: DataFrame, cluster_col: str = "failure_cluster") -> DataFrame:
    """Rows per cluster label."""
    return buffer.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n"))


def with_weights(buffer: DataFrame, rates: DataFrame | None, amplification: float = 5.0,
                 cluster_col: str = "failure_cluster") -> DataFrame:
    """Curriculum weight per row: 1 + rate x amplification (missing rate -> 0),
    normalised to sum 1 over the buffer when the sum is positive.

    ``rates`` has one row per cluster label.
    """
    if rates is None:
        raw = buffer.withColumn("raw_weight", F.lit(1.0))
    else:
        # not hinted: the planner broadcasts the table if it is small
        r = rates.select(F.col("cluster_name").alias("_cl"), F.col("failure_rate").alias("_rate"))
        raw = (buffer.join(r, buffer[cluster_col] == F.col("_cl"), "left")
               .withColumn("raw_weight", F.lit(1.0) + F.coalesce(F.col("_rate"), F.lit(0.0)) * F.lit(amplification))
               .drop("_cl", "_rate"))
    tot = raw.select(F.sum("raw_weight")).scalar()
    return raw.withColumn("weight", F.when(tot > 0, F.col("raw_weight") / tot).otherwise(F.col("raw_weight")))


def sample_uniform(buffer: DataFrame, n: int, seed: int = 42, seq_col: str = "seq") -> DataFrame:
    """n rows without replacement, uniformly (capped at the buffer size)."""
    keyed = buffer.withColumn("_u", hash_uniform(seq_col, seed))
    return top_k(keyed, n, "_u", descending=False, tie_cols=[F.col(seq_col).asc()]).drop("_u")


def sample_weighted(buffer: DataFrame, n: int, rates: DataFrame | None, seed: int = 42,
                    amplification: float = 5.0, seq_col: str = "seq",
                    cluster_col: str = "failure_cluster") -> DataFrame:
    """n rows without replacement with probability proportional to the weight.

    Efraimidis-Spirakis: key = -ln(u) / w, keep the n smallest keys; same
    distribution as successive weighted draws, computed as one bounded top-k.
    """
    w = with_weights(buffer, rates, amplification, cluster_col)
    keyed = w.withColumn("_key", -F.log(hash_uniform(seq_col, seed)) / F.col("raw_weight"))
    return top_k(keyed, n, "_key", descending=False, tie_cols=[F.col(seq_col).asc()]).drop("_key")


def round_dataset(buffer: DataFrame, n: int, rates: DataFrame | None, seed: int = 42,
                  amplification: float = 5.0) -> DataFrame:
    """One training round: weighted sample -> chat messages (empty buffer -> empty result)."""
    s = sample_weighted(buffer, n, rates, seed, amplification) if rates is not None else \
        sample_uniform(buffer, n, seed)
    return s.select("seq", "failure_cluster", chat_messages().alias("messages"))
