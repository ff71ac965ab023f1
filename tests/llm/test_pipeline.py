"""The corpus pipeline: each stage and the whole of it on a small corpus, against plain versions."""

from __future__ import annotations

import base64
import random
import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline

EXTRA = ["score", "predicted", "text_key", "token_ids", "n_tokens", "label", "prompt", "component"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"{name} int" for name in EXTRA)


def words(draw, count, stem):
    return [f"{stem}{draw.randint(0, 400)}" for _ in range(count)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean, toxic and poor documents, near copies, exact copies, one with a passage of the benchmark."""
    draw = random.Random(21)
    rows, labels = [], []
    for i in range(300):
        text, kind = words(draw, 40, "w"), i % 3
        if kind == 1:
            text[5:5] = ["vileword", "nastyphrase"]
        if kind == 2:
            text[5:5] = ["buy!!!", "click>>>", "££££"] * 3
        rows.append((i, " ".join(text)))
        labels.append((i, int(kind != 2), int(kind == 1)))
    item = words(draw, 60, "b")
    copied = rows[0][1].split()
    copied[3] = "changed"
    rows += [
        (1000, " ".join(copied)),
        (1001, rows[3][1]),
        (1002, " ".join(words(draw, 30, "w") + item + words(draw, 30, "w"))),
        (1003, None), (1004, ""), (1005, ""), (6, rows[6][1]), (None, " ".join(words(draw, 40, "w"))),
        (1006, " ".join(words(draw, 40, "w") * 400)),
    ]
    folder = str(tmp_path_factory.mktemp("corpus"))
    full = [(*row, *range(len(EXTRA))) for row in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    return folder, full, " ".join(item)


def shingles(text):
    said = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(said[i : i + 5]) for i in range(max(1, len(said) - 4))} if said else set()


def plain_one_of_each(rows):
    kept, sets = [], []
    ordered = sorted(rows, key=lambda row: (row[0] is None, row[0] or 0))
    for row in ordered:  # no chains of links in these rows
        own = shingles(row[1])
        if not own or not any(100 * len(own & x) >= 80 * len(own | x) for x in sets):
            kept.append(row)
            sets.append(own)
    return kept


def test_stages_keep_the_columns_and_take_what_they_should(spark, corpus):
    folder, rows, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = {
        "toxicity": [row for row in rows if "vileword" not in (row[1] or "")],
        "quality": [row for row in rows if "click>>>" not in (row[1] or "")],
        "near copies": plain_one_of_each(rows),
        "decontamination": [row for row in rows if item not in (row[1] or "")],
    }
    blank = {row for row in rows if not row[1]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns
        found = [tuple(row) for row in found.collect()]
        if name in ("toxicity", "quality"):  # texts without words may go either way, but together
            assert len(blank & set(found)) in (0, len(blank))
            assert sorted(set(found) - blank, key=str) == sorted(set(expected[name]) - blank, key=str)
        else:
            assert sorted(found, key=str) == sorted(expected[name], key=str)
        empty = stage(spark, docs.limit(0), folder)
        assert empty.columns == docs.columns and empty.count() == 0


def test_run_is_its_stages_in_turn(spark, corpus):
    folder, rows, item = corpus
    found = corpus_pipeline.run(spark, folder)
    names = ["token_ids_before" if name == "token_ids" else "n_tokens_before" if name == "n_tokens" else name for name in EXTRA]
    assert found.columns == ["doc_id", "text", *names, "token_ids", "n_tokens"]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    clean = [row for row in rows if not re.search("vileword|click>>>", row[1] or "") and item not in (row[1] or "")]
    expected = [row for row in plain_one_of_each(clean) if row[1]]
    found = [row for row in found.collect() if row["text"]]
    assert sorted((tuple(row)[:10] for row in found), key=str) == sorted(expected, key=str)
    for row in found:
        assert row["token_ids"] == library.encode_ordinary(row["text"]) and row["n_tokens"] == len(row["token_ids"])
