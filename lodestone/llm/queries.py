"""The operators as registered queries, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embed_dedup, mixing, ngram_join, passages, suffix_dedup, token_counts, token_files, toxicity
from .common import read_table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.classes(read_table(spark, sf_dir, "documents"), words=50, similarity=0.8, n=5)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-1, 0, "user", chat.ODD_TEXT), (-1, 1, "assistant", chat.ODD_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.chat_digest(chat.format_chat(chat.canonical_turns(rows.unionByName(odd))))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read_table(spark, sf_dir, "documents"), length=50).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(read_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "evidence")


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_decontamination, op3_embedding_dedup, op4_chat_formatting, op5_suffix_dedup, op6_token_counts, op7_token_files, op8_mixing,
    op9_ngram_join, op10_toxicity)}

ORACLE_SQL = {
    "op3_embedding_dedup": embed_dedup.ORACLE,
    "op4_chat_formatting": chat.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op9_ngram_join": ngram_join.ORACLE,
}
