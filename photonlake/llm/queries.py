"""Registered queries of the training-data operators: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from photonlake.llm import bpe, language, line_dedup, mixing, phrases, prefix_trie, rans, token_counts, topk, toxicity
from photonlake.llm.ann import PostingSearch
from photonlake.llm.embedding_dedup import SQL as _NEAR_VECTORS
from photonlake.llm.embedding_dedup import GraphNearDuplicates
from photonlake.llm.near_dup import NearDuplicates
from photonlake.llm.storage import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.corpus_history(spark, sf_dir)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(spark).run(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = rans.TokenFiles(spark, rans.library_tokenizer(public_tokenizers.path("byte_bpe_50k.json")), vocabulary=50257, end_id=0)
    return files.read(files.write(table(spark, sf_dir, "documents")))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.page_languages(spark, table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.PivotSearch(spark).run(table(spark, sf_dir, "embeddings"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(spark, table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(spark, table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PostingSearch(spark).run(table(spark, sf_dir, "embeddings"))


def op11_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GraphNearDuplicates(spark).run(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark, table(spark, sf_dir, "conversations"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrase_collocations(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_toxicity": op3_toxicity,
    "op4_token_files": op4_token_files,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_language_id": op6_language_id,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_source_mix": op8_source_mix,
    "op9_line_dedup": op9_line_dedup,
    "op10_nearest_neighbours": op10_nearest_neighbours,
    "op11_embedding_near_duplicates": op11_embedding_near_duplicates,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_top_k": topk.SQL,
    "op8_source_mix": mixing.SQL,
    "op11_embedding_near_duplicates": _NEAR_VECTORS,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_phrase_collocations": phrases.SQL,
}
