"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, language, lines, mixing, nearest, oracles, quality, repair, secrets, substring_bytes, substring_words, tokens, trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_bytes.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_words.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.remove_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digested(repair.repair(repair.damaged(_table(spark, sf_dir, "conversations"))))


def base_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10 gives besides the spans that the method adds: SQL can express it."""
    return op10_secret_scans(spark, sf_dir).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_benchmark_decontamination, op2_ngram_jaccard_join, op3_mixing_sources, op4_nearest_neighbours, op5_suffix_array_dedup, op6_quality_classifier, op7_token_counts, op8_language_id, op9_substring_dedup, op10_secret_scans, op11_line_dedup, op12_conversation_trie, op13_conversation_repair, base_secret_spans)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
