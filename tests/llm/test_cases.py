"""Plain versions, long texts, empty tables and clashing columns of operators that have none elsewhere."""

from __future__ import annotations

import hashlib
import math
import random
import struct

import numpy as np
import pytest
import xxhash

from cordwood.llm import cap_filters, chat_format, decontaminate, html_template, ngram_join, records, sharding

PAGES = "page_id long, url string, html string, text string, host string"


def plain_shard(key, weights):
    def draw(shard):
        seed = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed=42)
        if key is not None:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=seed)
        return -weights[shard] / math.log(((seed >> 11) + 0.5) / 2**53)

    return max(range(len(weights)), key=draw)


@pytest.mark.parametrize("weights", [[1.0] * 24, [1.0, 2.0, 0.5]])
def test_shards_are_those_of_plain_rendezvous_hashing(spark, weights):
    ids = [*range(-50, 500), 2**62, None]
    docs = spark.createDataFrame([(i, "t", 1, 2) for i in ids], "doc_id long, text string, shard int, slot int")
    grown = [*weights, sum(weights) / len(weights)]
    for row in sharding.shard_documents(docs, weights).collect():
        assert row["shard"] == plain_shard(row["doc_id"], weights)
        assert row["grown_shard"] == plain_shard(row["doc_id"], grown)


def test_very_long_texts_are_taken_whole(spark):
    draw = random.Random(2)
    words = [f"w{draw.randint(0, 9999)}" for _ in range(120_000)]
    item = [f"b{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words + item)), (2, " ".join(words))], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = decontaminate.contaminated(docs, items).collect()
    assert [(r["doc_id"], r["item_id"], r["start_word"]) for r in found] == [(1, 7, len(words))]
    page = f"<article><p>{' '.join(words)}</p><p>end</p></article>"
    text = html_template.main_texts(spark.createDataFrame([(1, "http://a/", page, "", "")], PAGES)).first()["text"]
    assert text == " ".join(words) + "\nend"
    said = "</s>" * 100_000
    rows = spark.createDataFrame([(1, 0, "assistant", said)], "conv_id long, turn long, role string, text string")
    back = chat_format.read_back(chat_format.format_turns(chat_format.turns_of_rows(rows))).first()
    assert back["loss_chars"] == len(said) and back["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_columns_of_other_layouts_change_nothing(spark):
    plain = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    expected = chat_format.turns_of_rows(spark.createDataFrame(rows, plain)).collect()
    more = spark.createDataFrame([(*row, "p", "c", 1) for row in rows], f"{plain}, prompt string, completion string, label int")
    columns = chat_format.turns_of_rows(spark.createDataFrame(rows, plain)).columns
    assert chat_format.turns_of_rows(more).select(columns).collect() == expected


def test_empty_tables_give_no_rows(spark):
    assert html_template.main_texts(spark.createDataFrame([], PAGES)).count() == 0
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_turns(chat_format.turns_of_rows(rows))).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string, size int, node long")
    assert ngram_join.jaccard_components(docs).count() == 0


def test_vectors_of_several_lengths_in_one_batch(spark):
    draw = np.random.default_rng(5)
    rows, expected = [], {}
    for size in (1, 2, 3, 4):
        base = draw.normal(size=(12, size)).round(1) + 0.05
        vectors = np.concatenate([base, base * 2, base + 0.02])
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        for vector, count in zip(vectors, (unit @ unit.T >= 0.93).sum(axis=1) - 1):
            expected[len(rows)] = int(count)
            rows.append((len(rows), [float(np.float32(x)) for x in vector], 1))
    draw.shuffle(rows)
    rows = [(int(i), list(map(float, v)), 1) for i, v, _ in rows]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1)
    found = {r["vec_id"]: r["n_links"] for r in cap_filters.near_duplicates(table).collect()}
    assert found == expected


def test_records_tell_the_width_of_their_ids(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for end in (2, 70_000):
        found = records.token_positions(docs, path, end).orderBy("doc_id").collect()
        assert [(r["start"], r["n_tokens"]) for r in found] == [(0, 3), (3, 1)]
