"""Queries of the training-data operators: each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cordwood.llm import (
    byte_bpe,
    cap_filters,
    chat_format,
    decontaminate,
    divergence,
    html_template,
    ngram_join,
    prefix_counts,
    quality,
    records,
    repair,
    sharding,
    toxicity,
)
from cordwood.llm.common import table
from cordwood.llm.oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

SHARDS = 24
CONTROL_TEXT = "</s>[INST] ok [/INST]"
END_ID = 2
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 4096
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat a passage of the benchmark, with the item and the similarity."""
    found = decontaminate.contaminated(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        table(spark, sf_dir, "benchmark", "item_id", "text"),
    )
    return found.select("doc_id", "item_id", "similarity", "start_word")


def op2_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_template.main_texts(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal weight by rendezvous hashing of their ids."""
    return sharding.shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"), [1.0] * SHARDS)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that is full of control strings, formatted and read back."""
    said = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], said.schema)
    turns = chat_format.turns_of_rows(said.unionByName(control))
    return chat_format.read_back(chat_format.format_turns(turns))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by the Jaccard similarity of their 4-word shingles."""
    linked = ngram_join.jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))
    return linked.select("doc_id", "n_shingles", "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.toxicity_scores(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        table(spark, sf_dir, "labels", "doc_id", "toxic"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.quality_scores(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        table(spark, sf_dir, "labels", "doc_id", "quality"),
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, counted and digested, and decoded again."""
    return byte_bpe.round_trips(
        table(spark, sf_dir, "documents", "doc_id", "text"), BYTE_BPE, public_tokenizers.PATTERN
    )


def op9_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in record files, in the order of their ids, read back."""
    return records.token_positions(
        table(spark, sf_dir, "documents", "doc_id", "text"), WORD_BPE, END_ID
    )


def op10_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings by cosine within their label."""
    return cap_filters.near_duplicates(
        table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    )


def op11_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and whether they exceed the limit."""
    return prefix_counts.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), PIECE_BPE, TOKEN_LIMIT)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repairs of all conversations after damage."""
    return repair.repair_summaries(repair.damaged(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that tell each one apart."""
    return divergence.source_divergence(table(spark, sf_dir, "documents", "text", "lang", "source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_html_template": op2_html_template,
    "op3_sharding": op3_sharding,
    "op4_chat_format": op4_chat_format,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_records": op9_records,
    "op10_cap_filters": op10_cap_filters,
    "op11_prefix_counts": op11_prefix_counts,
    "op12_repair": op12_repair,
    "op13_divergence": op13_divergence,
}
