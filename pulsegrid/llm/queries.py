"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.llm import alignment, decontaminate, lattice, licenses, lines, lmscore, mixing, prefix_trie, quality, sharding, simhash, suffix_dedup, toxicity
from pulsegrid.llm.common import held_out, table


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dropped_lines(table(spark, sf_dir, "documents"), min_words=1)  # every line that has a word
    return found.withColumn("n_dropped", F.size("dropped")).select("doc_id", "n_lines", "n_dropped", "dropped")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.stupid_backoff(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity.toxicity(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lattice": op1_lattice,
    "op2_fuzzy_lines": op2_fuzzy_lines,
    "op3_licenses": op3_licenses,
    "op4_lm_score": op4_lm_score,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_quality": op10_quality,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_alignment": op13_alignment,
}
ORACLES = {"op5_mixing": mixing.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE}
