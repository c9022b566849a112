"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themelift.llm import boosted_trees, quality_rules, secrets, toxicity, warc
from themelift.llm.bpe import token_digests
from themelift.llm.common import read_table
from themelift.llm.divergence import divergence
from themelift.llm.html_extract import extract
from themelift.llm.lexical_blocks import ranked_search
from themelift.llm.oracle import ORACLE
from themelift.llm.packing import pack_documents
from themelift.llm.simhash import hex_digits, near_copies
from themelift.llm.substring import remove_passages
from themelift.llm.topk import integer_vectors, top_k


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(read_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.breaks("base").alias("base_failed"),
        (~quality_rules.breaks(quality_rules.CURRENT)).alias("kept"),
        "failures",
    )


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.archive(read_table(spark, sf_dir, "pages"))
    return warc.page_records(spark, archives).drop("url")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosted_trees.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_passages(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("id") % 50 == 0))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(read_table(spark, sf_dir, "documents"))
    counts = [F.size(secrets.of_kinds(k)).cast("long").alias(f"n_{k}") for k in secrets.BASE_KINDS]
    base = secrets.listed(secrets.of_kinds(*secrets.BASE_KINDS))
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secrets.listed(F.col("found")).alias("spans"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_warc_revisits,
        op3_quality_classifier,
        op4_simhash_near_dedup,
        op5_substring_dedup,
        op6_exact_top_k,
        op7_toxicity,
        op8_packing,
        op9_main_text,
        op10_bpe_round_trip,
        op11_ranked_search,
        op12_secret_scan,
        op13_source_divergence,
    )
}

__all__ = ["ORACLE", "QUERIES"]
