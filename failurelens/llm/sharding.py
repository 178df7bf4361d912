"""Shards that all match the corpus' mixture, by proportional stratified interleaving.

Rows are shuffled by a seeded digest and ranked within their stratum (source); row r of a
stratum with n rows gets the fractional rank (r + u) / n, where u in [0, 1) is a seeded
offset of the stratum. Sorted by fractional rank, every stratum is spread evenly, so
cutting the order into ranges of equal row counts gives shards with the corpus' mixture:
between two fractional ranks a stratum has its share to within one row, and a cut is off
its fractional rank by the sum of these roundings, at most one row for each stratum. The
offsets keep the many strata of one row apart, which would else all stand at one place.

No task gets a whole stratum or the whole order. Both orders are dealt into 65,536 ranges:
a window numbers the rows of a range, and running sums over the ranges' counts, in two levels
of at most 256 rows each, shift the numbers. Ranges of a stratum are those of the digest,
ranges of the whole those of the fractional rank, so both are even, however large a stratum
is. Only built-in functions are used.

Defined results: the law is ``rows``: shard sizes differ by one at most, and slots count
from 0 without gaps. A null or clashing value is a value like any other: rows with a null
stratum form a stratum. Rows that are equal in every column are counted first and numbered,
and get as many places; their order can't be told. Shards may be empty if there are fewer
rows than shards; an empty table gives an empty result. Columns must be comparable (no maps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from failurelens.llm.common import shared_table

#: Ranges of a stratum and of the whole order, and how many make a block of the running sums.
RANGES, BLOCK = 1 << 16, 1 << 8
#: Equal rows are unfolded in pieces of this many, dealt to tasks.
PIECE = 1 << 16


def unfolded(rows: DataFrame, own: str) -> DataFrame:
    """The rows with ``own``.copy: 0, 1, ... among rows that are equal in every column."""
    counted = rows.groupBy(*[F.col(f"`{c}`") for c in rows.columns]).agg(F.count(F.lit(1)).alias(own))

    def numbers(low: Column, n: Column) -> Column:
        return F.explode(F.sequence(low, low + n - 1))

    few = counted.filter(F.col(own) <= PIECE).withColumn(own, numbers(F.lit(0).cast("long"), F.col(own)))
    piece, left = own + "_piece", F.least(F.col(own) - F.col(own + "_piece") * PIECE, F.lit(PIECE))
    many = (counted.filter(F.col(own) > PIECE)
            .withColumn(piece, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{own}` - 1) div {PIECE}"))))
            .repartition(F.col(piece)).withColumn(own, numbers(F.col(piece) * PIECE, left)).drop(piece))
    return few.unionByName(many)


def written(column: Column) -> Column:
    """A value's text for the digest; null differs from every text."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("!"))


def fraction(text: Column) -> Column:
    """A number in [0, 1) from 48 bits of the text's md5 digest."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def starts(counts: DataFrame, group: list[str], part: str, n: str, into: str) -> DataFrame:
    """``counts`` with the sum of ``n`` over the group's lesser parts in ``into``, and over all its parts in ``n``.

    Two levels: a window sees the parts of one block, or the blocks of one group.
    """
    block, sums, rest = into + "_block", into + "_sum", W.unboundedPreceding
    blocks = counts.withColumn(block, F.expr(f"`{part}` div {BLOCK}"))
    tops = blocks.groupBy(*group, block).agg(F.sum(n).alias(sums))
    over = W.partitionBy(*group)
    tops = (tops.withColumn(into, F.sum(sums).over(over.orderBy(block).rowsBetween(rest, 0)) - F.col(sums))
            .withColumn(sums, F.sum(sums).over(over)))
    inner = W.partitionBy(*group, block).orderBy(part).rowsBetween(rest, 0)
    return (blocks.withColumn(into + "_in", F.sum(n).over(inner) - F.col(n)).drop(n)
            .join(tops, [*group, block])
            .select(*group, part, (F.col(into) + F.col(into + "_in")).alias(into), F.col(sums).alias(n)))


def interleave(rows: DataFrame, stratum: str, identity: list[str], n_shards: int, seed: int = 0) -> DataFrame:
    """``rows`` with shard (0 to ``n_shards`` - 1) and slot (place in the shard).

    ``identity`` names the columns whose values, with the seed, decide the shuffle. Existing
    columns shard and slot are replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    keep = [c for c in rows.columns if c not in ("shard", "slot")]
    own = "_" * (1 + max([len(c) for c in keep] + [0])) + "own"  # longer than any input column's name
    copy, order, group, part, n, place, rank = (own + s for s in ("copy", "order", "group", "part", "n", "place", "rank"))

    numbered = unfolded(rows.select(*[F.col(f"`{c}`") for c in keep]), copy)
    told = [F.lit(str(seed)), *[written(F.col(f"`{c}`")) for c in identity], F.col(copy).cast("string")]
    table = shared_table(numbered.withColumns({
        group: written(F.col(f"`{stratum}`")), order: F.md5(F.concat_ws("|", *told))}), "shard-rows")
    table = table.withColumn(part, F.conv(F.substring(order, 1, 4), 16, 10).cast("int"))  # RANGES of them

    shift = starts(table.groupBy(group, part).agg(F.count(F.lit(1)).alias(n)), [group], part, n, place)
    # the same order whenever a lost task runs again
    same = [F.col(order), F.xxhash64(*[F.col(f"`{c}`") for c in keep]), F.col(copy)]
    ranked = (table.withColumn(rank, F.row_number().over(W.partitionBy(group, part).orderBy(*same)) - 1)
              .join(shift, [group, part])
              .withColumn(rank, (F.col(rank) + F.col(place) + fraction(F.concat_ws("|", F.lit(str(seed)), F.col(group)))) / F.col(n))
              .withColumn(part, F.least(F.floor(F.col(rank) * RANGES), F.lit(RANGES - 1)).cast("int"))
              .drop(n, place))
    ranked = shared_table(ranked, "shard-ranks")

    shift = starts(ranked.groupBy(part).agg(F.count(F.lit(1)).alias(n)), [], part, n, place)
    at = F.col(place) + F.row_number().over(W.partitionBy(part).orderBy(rank, group, *same)) - 1
    placed = ranked.join(shift, part).withColumn(place, at)
    shard = F.expr(f"`{place}` * {n_shards} div `{n}`")
    first = F.expr(f"(`{own}` * `{n}` + {n_shards - 1}) div {n_shards}")
    return (placed.withColumn(own, shard).withColumn("slot", F.col(place) - first)
            .select(*[F.col(f"`{c}`") for c in keep], F.col(own).cast("int").alias("shard"), "slot"))


def write_shards(rows: DataFrame, path: str, stratum: str, identity: list[str], n_shards: int, seed: int = 0,
                 files: int = 16) -> None:
    """Whole rows as Parquet, one folder ``shard=k`` for each shard, in slot order.

    A shard is written by ``files`` tasks, each a range of slots; their files' names sort as the slots do.
    """
    placed = interleave(rows, stratum, identity, n_shards, seed)
    placed.repartitionByRange(n_shards * files, "shard", "slot").sortWithinPartitions("shard", "slot") \
        .write.mode("overwrite").partitionBy("shard").parquet(path)


def report(docs: DataFrame, n_shards: int = 8, seed: int = 0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, source), one row for each row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus one; a null text counts as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"),
                         F.crc32(text).alias("text_crc32"))
    placed = interleave(narrow, "source", ["doc_id", "size", "text_crc32"], n_shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "source")


#: The report with 8 shards and seed 0. CRC-32 is worked out byte by byte from its polynomial.
ORACLE = """
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
         CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
raw AS (SELECT doc_id, source, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
          lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
plain AS (SELECT doc_id, source, CAST(len(bytes) + 1 AS BIGINT) AS size, xor(list_reduce(bytes, lambda c, b:
            xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) AS text_crc32 FROM raw, steps),
ordered AS (SELECT *, coalesce('=' || source, '!') AS stratum, md5('0|' || coalesce('=' || doc_id, '!') || '|=' || size
              || '|=' || text_crc32 || '|' || (row_number() OVER (PARTITION BY doc_id, source, size, text_crc32) - 1)) AS o
            FROM plain),
ranked AS (SELECT *, ((row_number() OVER (PARTITION BY stratum ORDER BY o) - 1)
             + CAST('0x' || substr(md5('0|' || stratum), 1, 12) AS BIGINT) / CAST(281474976710656 AS DOUBLE))
             / count(*) OVER (PARTITION BY stratum) AS part FROM ordered),
placed AS (SELECT *, row_number() OVER (ORDER BY part, stratum, o) - 1 AS place, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 8 // n AS INTEGER) AS shard,
  CAST(place - ((place * 8 // n) * n + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM placed
"""
