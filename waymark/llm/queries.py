"""The queries opN_<name>: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, embedding_dedup, html_extraction, line_dedup, mixing, prefix_trie, quality_classifier, quality_rules, simhash, substring_dedup, unigram_lm, url_filters
from ._common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.in_order(mixing.mix(table(spark, sf_dir, "documents")))
    return m.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"), *[F.try_element_at(F.col("__passes.position"), F.lit(k)).alias(f"position_{k}") for k in (1, 2)])


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_classifier.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score = F.col("__score")
    return d.select("doc_id", F.col("__held_out").alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.judge(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))


def op10_unigram_lm(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return unigram_lm.score(table(spark, sf_dir, "documents"), path or public_tokenizers.path("piece_bpe_32k.model"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = url_filters.judged(table(spark, sf_dir, "pages").select("page_id", "url"))
    return d.select("page_id", *[F.col(f"__{n}").alias(n) for n in ("host", "path", "rule", "verdict")], F.col("__glob").alias("pattern"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations"))).drop("key")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_mixing, op3_quality_classifier, op4_html_extraction, op5_quality_rules,
        op6_simhash, op7_embedding_dedup, op8_line_dedup, op9_bpe, op10_unigram_lm,
        op11_url_filters, op12_prefix_trie, op13_collocations,
    )
}
