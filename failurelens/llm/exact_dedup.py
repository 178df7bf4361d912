"""Exact duplicates by skew-safe combining of whole texts.

Three merges, each grouping by the full text (the digest only routes rows):

1. locally: the map-side part of each aggregate keeps one row per distinct text of a
   partition, so a partition sends at most one row per text and salt;
2. per salt: a digest with more than 1/1024 of all rows (at most 1,023 digests can
   have that, so their list is broadcast) is spread over ``salts`` groups;
3. globally: the few salt winners of such digests are combined.

Other digests are complete after their first merge, so each text is shuffled once at most.

Defined results: a null text counts as empty; the row with the largest id stays, a null
id loses against any other and stays only if the group has no other; rows that repeat
both id and text are one document, all marked alike in the report, of which
``drop_duplicates`` keeps one row (any, if other columns differ); an empty table gives an empty
result; other columns are ignored. A digest shared by different texts is settled by
comparing the texts themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failurelens.llm.common import shared_table, unused

#: A digest is spread over salts if it has more than one row in this many.
HOT_SHARE = 1024
SALTS = 32


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def duplicate_report(docs: DataFrame, salts: int = SALTS, digest=sha256_hex) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``.

    ``digest`` routes texts; any function of the text gives the same groups.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", whole.alias("text"))
    routed = rows.withColumn("digest", digest(F.col("text")))

    counts = routed.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)))
    hot = F.broadcast(counts.filter(F.col("n") * HOT_SHARE > total.scalar()).select("digest"))

    best = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")]
    merged = [F.max("keep_id").alias("keep_id"), F.sum("n").alias("n")]
    cold_groups = (routed.join(hot, "digest", "left_anti")
                   .groupBy("digest", "text").agg(*best))
    hot_groups = (routed.join(hot, "digest", "left_semi")
                  .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
                  .groupBy("digest", "salt", "text").agg(*best)
                  .groupBy("digest", "text").agg(*merged))
    groups = cold_groups.unionByName(hot_groups)

    summary = shared_table(
        groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"),
                                     F.max("n").alias("group_size")), "dedup-groups")
    members = routed.select("doc_id", "digest", sha256_hex(F.col("text")).alias("text_sha256"))
    report = members.join(summary.filter("texts = 1").drop("texts"), "digest")
    shared = summary.filter("texts > 1")
    if not shared.isEmpty():
        names = F.broadcast(shared.select("digest"))
        settled = groups.join(names, "digest", "left_semi").withColumnRenamed("n", "group_size")
        others = (routed.join(names, "digest", "left_semi").join(settled, ["digest", "text"])
                  .withColumn("text_sha256", sha256_hex(F.col("text"))))
        report = report.unionByName(others.select(report.columns))
    return report.select("doc_id", "keep_id", "group_size",
                         F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, all columns as they were.

    One shuffle deals the rows by text digest and id: copies have different ids, and rows
    that repeat both are merged within their partition before it.
    """
    sha, own, null = (unused(docs, c) for c in ("own_sha", "own_id", "own_null"))
    tag = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(own), F.col("doc_id").isNull().alias(null)]
    keep = (duplicate_report(docs, salts).filter("kept")
            .select(F.col("text_sha256").alias(sha), F.col("keep_id").alias("doc_id")).select(sha, *tag).distinct())
    tagged = docs.select("*", sha256_hex(F.coalesce(F.col("text"), F.lit(""))).alias(sha), *tag)
    return tagged.dropDuplicates([sha, own, null]).join(keep, [sha, own, null], "left_semi").drop(sha, own, null)


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
