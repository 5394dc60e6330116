"""The registered queries of the training-data operators: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkweave.llm import budget_mix, collocations, cover_tree, hilbert, length_histogram, license_scan, packing, prefix_free, prefix_trie, quality_rules, simhash, substring, url_filter
from chunkweave.llm.common import read
from chunkweave.llm.oracle import oracle_sql  # noqa: F401  registered with the queries

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram.length_histogram(length_histogram.token_counts(read(spark, sf_dir, "documents")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = url_filter.learned_marks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    rows = url_filter.addresses(read(spark, sf_dir, "pages"), marks)
    return url_filter.judged(rows, url_filter.listed_urls(rows)).drop("bloom_hit")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3)


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.hilbert_shards(read(spark, sf_dir, "documents"), shards=8, law="bytes")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality_rules.document_stats(read(spark, sf_dir, "documents"))
    found = quality_rules.judged(stats, quality_rules.learn_from(stats, read(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op6_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = budget_mix.mixed(read(spark, sf_dir, "documents"), budget_mix.n_words(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read(spark, sf_dir, "documents"))


def op8_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents")).drop("places")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicated(read(spark, sf_dir, "documents"), k=13, with_rows=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(read(spark, sf_dir, "conversations"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free.deduplicated(read(spark, sf_dir, "documents"), k=50, with_text=False)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"), threshold=30, most=2000)


QUERIES = (op1_token_length_histogram, op2_url_filter, op3_simhash_near_dedup, op4_hilbert_shards, op5_quality_rules, op6_budget_mix, op7_best_fit_packing, op8_cover_tree_topk, op9_license_scan, op10_substring_dedup, op11_conversation_trie, op12_suffix_dedup, op13_phrase_collocations)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}
