"""The corpus pipeline: language identification, line and near-duplicate removal, source mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the
shared folder and rereads it for the next stage. Columns beside those of documents pass through; an empty table stays one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.llm import bpe, language
from photonlake.llm.line_dedup import LineDedup
from photonlake.llm.mixing import Mixture
from photonlake.llm.near_dup import NearDuplicates
from photonlake.llm.storage import Scratch, bounded_batches


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, with that language; null and empty texts, and texts without letters, go."""
    return language.document_languages(spark, docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that occurred before; documents that consisted of nothing else go. Null and empty texts stay."""
    out = LineDedup(spark).run(docs)
    emptied = (F.size("removed_lines") > 0) & (F.btrim("text", F.lit(" \t\r\n\x0b\x0c")) == "")
    out = out.filter(~F.coalesce(emptied, F.lit(False)))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id (all rows of that id). Rows without an id or without words stay."""
    kept = NearDuplicates(spark).run(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.filter("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for, by shard and in shuffled order within each. Null sources are one source."""
    drawn = Mixture(spark).draw(docs)
    return drawn.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding: doc_id, source, lang, n_tokens, ids, round_trip. A null text has no ids."""
    bounded_batches(spark)
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    both = bpe.encode_decode(docs.select("doc_id", "source", "lang", "text", digest.alias("digest")), vocabulary)
    same = F.sha2("decoded", 256) == F.col("digest")
    return both.select("doc_id", "source", "lang", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("source_mix", mix),
    ("byte_bpe", tokens),
]

#: The sketches and the tokeniser cannot be expressed in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
