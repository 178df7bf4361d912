"""Corpus clean-up: the stages that turn ``documents`` into training tokens.

Each stage takes what its predecessor kept; all but the last return the columns of
``documents``. Nulls, empty tables, repeated rows and extra columns have the results that
each operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failurelens.llm import bpe, decontaminate, exact_dedup, jaccard_join, toxicity
from failurelens.llm.common import read_table, shared_table
from failurelens.llm.queries import toxicity_network, word_vocabulary

#: A document with this score or more goes.
TOXIC_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on the labelled ones of ``sf_dir``, scores below TOXIC_SCORE."""
    scored = toxicity.with_score(docs, toxicity_network(spark, sf_dir), "__score")
    return scored.filter(F.col("__score") < TOXIC_SCORE).drop("__score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays, that with the largest id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 one stays, that with the smallest id."""
    return jaccard_join.keep_one(docs, jaccard_join.Rule())


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words (or a whole shorter item) of ``benchmark``."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, with digests of the ids and of the text they decode to."""
    tokens = bpe.tokenize(docs.select("doc_id", "lang", "source", "text"), word_vocabulary(),
                          ["ids", "n_tokens", "ids_sha256", "decoded_sha256"])
    return tokens.drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("BPE encoding and decoding", to_tokens),
]

#: The first stage is a trained network and the last a tokenizer: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
