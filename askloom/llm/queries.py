"""Registered queries of this subpackage, each over its whole table, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm import byte_bpe, chat_rotation, cross_tokenizer, decontamination, fill_in_middle, line_dedup, maxent_lm, ngram_join, ordinal_quality, piece_bpe, token_counts, topk, toxicity
from askloom.llm.tables import read, staged

__all__ = ["ORACLE", "QUERIES", "read", "staged", "tokenizer_file"]

TOKEN_LIMIT = 4096


def tokenizer_file(name: str) -> bytes:
    """Content of a public tokenizer's file (at most a few MB), so executors need not see its path."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"), size=4, num=85, den=100).drop("n_copies")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality.score(read(spark, sf_dir, "documents"), ordinal_quality.graded(read(spark, sf_dir, "labels")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    n_lines, n_removed = line_dedup.count_names(docs)
    return line_dedup.dedup_lines(docs).select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_removed).alias("n_removed"), "text")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.segments(read(spark, sf_dir, "conversations"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(read(spark, sf_dir, "documents"))


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digests(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer.align(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_join": op2_ngram_join,
    "op3_quality": op3_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_topk": op7_topk,
    "op8_chat_rotation": op8_chat_rotation,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_lm_scores": op10_lm_scores,
    "op11_piece_bpe": op11_piece_bpe,
    "op12_cross_tokenizer": op12_cross_tokenizer,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE: dict[str, str] = {
    "op2_ngram_join": ngram_join.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op7_topk": topk.ORACLE,
    "op8_chat_rotation": chat_rotation.ORACLE,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}
