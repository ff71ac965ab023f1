"""A corpus from raw documents: toxic and poor ones go, one of each group of near copies stays,
what repeats a benchmark goes, and the rest is tokenised.

Each stage is written as Parquet in the shared folder and read again by the next one; the tables
of all but the last stage but one are deleted as soon as the next one is written. Columns beside
doc_id and text may have any names and come back as they were, in the last stage as
``<name>_before`` if they are called token_ids or n_tokens. Null and empty texts are judged alike and
stay as near copies of nothing; of repeated rows one stays; an empty table gives no rows.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordwood.llm.byte_bpe import encode_documents
from cordwood.llm.common import Scratch, making_room, maybe_broadcast, put_back, set_apart, table
from cordwood.llm.decontaminate import contaminated
from cordwood.llm.ngram_join import jaccard_components, keep_one
from cordwood.llm.quality import judge_quality
from cordwood.llm.toxicity import judge_toxicity

# Near copies have a Jaccard similarity of at least 80 % on shingles of five words.
NEAR_WORDS, NEAR_THRESHOLD = 5, 80
# The columns that stages read.
NEEDED = ("doc_id", "text")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; a null text is judged as an empty one."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    learnt_from = table(spark, sf_dir, "documents", "doc_id", "text")
    judged = judge_toxicity(set_apart(docs, *NEEDED), learnt_from, labels)
    return put_back(judged.where("predicted = 0"), docs, *NEEDED)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality reaches the threshold; a null text is judged as an empty one."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    learnt_from = table(spark, sf_dir, "documents", "doc_id", "text")
    judged = judge_quality(set_apart(docs, *NEEDED), learnt_from, labels)
    return put_back(judged.where("predicted = 1"), docs, *NEEDED)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies; documents without words all stay."""
    return keep_one(docs, jaccard_components(docs, NEAR_WORDS, NEAR_THRESHOLD))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; equal texts go together."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    texts = Scratch(spark, "leaks").store(found.select("text_key").distinct(), "texts")
    leaks = maybe_broadcast(texts, texts.count())
    plain = set_apart(docs, *NEEDED)
    clean = plain.join(leaks, F.xxhash64(plain["text"]) == leaks["text_key"], "left_anti")
    return put_back(clean, docs, *NEEDED)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their whole texts; a null text has no ids."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode_documents(making_room(docs, "token_ids", "n_tokens"), path, public_tokenizers.PATTERN)
    return encoded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("near copies", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("byte-level BPE", tokenised),
]

# The classifiers and the tokeniser are beyond SQL; tests/llm/test_pipeline.py holds the stages and
# run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, each on what the one before has kept."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        step = stage(spark, docs, sf_dir)
        if place + 1 == len(STAGES):
            return step
        docs = scratch.store(step, str(place))
        if place:
            scratch.drop(str(place - 1))
    return docs
