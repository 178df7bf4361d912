"""Queries of the corpus operators over the given tables, with their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failurelens.llm.common import held_out, read_table
from failurelens.llm import (alignment, bpe, decontaminate, exact_dedup, jaccard_join, langid, licenses, periodic_runs, pii,
                             quality, sharding, substring_dedup, toxicity)


def word_vocabulary() -> str:
    """The word-end BPE file that the token queries use."""
    return public_tokenizers.path("word_bpe_49k.json")


#: The key of the registered query; a user passes a secret one.
PSEUDONYM_KEY = "corpus-demo-key"


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PSEUDONYM_KEY)


def op2_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held = held_out(F.col("doc_id"), 3, 1)
    return quality.score(docs, quality.fit(docs, labels, ~held), held)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.tokenize(docs, word_vocabulary(), ["n_tokens", "ids_sha256", "decoded_sha256"]).drop("text")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_report(read_table(spark, sf_dir, "documents"))


def op5_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(read_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = jaccard_join.Rule(k=4, num=85, den=100)
    return jaccard_join.similarity_components(read_table(spark, sf_dir, "documents"), rule)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def toxicity_network(spark: SparkSession, sf_dir: str) -> toxicity.Network:
    """Fitted on the labelled documents whose crc32(doc_id) mod 4 is not 2."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.fit(docs, labels, ~held_out(F.col("doc_id"), 4, 2))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    network = toxicity_network(spark, sf_dir)
    return toxicity.score(read_table(spark, sf_dir, "documents"), network, held_out(F.col("doc_id"), 4, 2))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(read_table(spark, sf_dir, "documents")).drop("kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 4, 2)
    vocabulary = langid.piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    model = langid.learn(docs.filter(~held), vocabulary)
    return langid.predict(docs, model, held)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(periodic_runs.looped(read_table(spark, sf_dir, "documents")))


def op12_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(read_table(spark, sf_dir, "documents"), n_shards=8)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.report(read_table(spark, sf_dir, "documents"), paths)


QUERIES = {
    "op1_pii_pseudonyms": op1_pii_pseudonyms,
    "op2_quality_neighbours": op2_quality_neighbours,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_license_digests": op5_license_digests,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_stratified_shards": op12_stratified_shards,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_license_digests": licenses.ORACLE,
    "op6_jaccard_join": jaccard_join.ORACLE,
    "op7_decontamination": decontaminate.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
    "op12_stratified_shards": sharding.ORACLE,
}
