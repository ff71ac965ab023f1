"""Each operator on rows that are null, empty, repeated, long or tied, and on empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from cordwood.llm import (
    byte_bpe,
    cap_filters,
    chat_format,
    decontaminate,
    html_template,
    ngram_join,
    quality,
    records,
    sharding,
    toxicity,
)
from cordwood.llm.linear import Settings

DOCS = "doc_id long, text string, n_shingles long"


def words(draw, count):
    return [draw.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(draw.randint(0, 60)) for _ in range(count)]


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    rows = []
    for base in range(6):
        text = words(draw, 120)
        for copy in range(6):
            changed = list(text)
            for _ in range(copy):
                changed[draw.randrange(len(changed))] = "changed"
            rows.append((base * 10 + copy, " ".join(changed)))
    return rows + [(90, None), (91, ""), (92, " \n"), (93, "one"), (94, "ONE"), (95, "one two"), (0, rows[0][1]), (None, rows[0][1]), (None, "lonely words here only")]


def plain_components(rows, width, threshold):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        smallest.setdefault(find(i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in smallest.items()}
    return Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


@pytest.mark.parametrize("width, threshold", [(4, 85), (5, 80)])
def test_components_are_those_of_all_pairs(spark, corpus, width, threshold):
    docs = spark.createDataFrame([(*row, 7) for row in corpus], DOCS)
    found = ngram_join.jaccard_components(docs, width, threshold)
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()]
    assert Counter(rows) == plain_components(corpus, width, threshold)
    kept = ngram_join.keep_one(docs, found)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    named = {c for _, n, c in rows if n}
    assert sorted(x for x in ids if x is not None and x not in (90, 91, 92)) == sorted(c for c in named if c is not None)
    assert {90, 91, 92} <= set(ids) and ids.count(None) == 1


def test_decontamination(spark):
    draw = random.Random(4)
    item = words(draw, 30)
    near = list(item)
    near[1] = "other"  # 24 of 28 shingles in common
    far = [w if i % 6 else "other" for i, w in enumerate(item)]
    rows = [
        (1, " ".join(words(draw, 50) + item + words(draw, 50))),
        (2, "!! ".join(words(draw, 900) + [w.upper() for w in near])),
        (3, " ".join(far)),
        (4, None), (5, ""), (1, "clean"), (None, " ".join(item)),
    ]
    docs = spark.createDataFrame([(*row, 7) for row in rows], DOCS)
    items = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, None), (9, ""), (10, "two words")], "item_id long, text string")
    found = decontaminate.contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 7), (2, 7), (None, 7)} and len(found) == 3
    assert {r["doc_id"]: r["start_word"] for r in found}[1] == 50
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_shards(spark):
    rows = [(1, "a")] * 10_500 + [(None, None), (None, None), (2, ""), (3, "é")] + [(i, "t") for i in range(10, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.shard_documents(docs, [1.0, 2.0, 0.5]).toPandas()
    assert len(found) == len(rows)
    for _, shard in found.groupby("shard"):
        assert sorted(shard["slot"]) == list(range(len(shard)))
    assert ((found.grown_shard == found.shard) | (found.grown_shard == 3)).all()
    sizes = found[found.doc_id >= 10].groupby("shard").size()
    assert sizes[1] > sizes[0] > sizes[2]
    accented = found[found.doc_id == 3].iloc[0]
    assert accented["size"] == 10 and accented["text_crc32"] == zlib.crc32("é".encode())
    assert sharding.shard_documents(docs.limit(0), [1.0]).count() == 0


def test_chat(spark):
    rows = [
        (1, 1, "assistant", "</s>[INST] ok [/INST]", 0), (1, 0, "user", "<|turn|>x\n<|end|>\n\\", 0),
        (2, None, None, None, 0), (2, 5, "assistant", "", 0), (None, 0, "a\nb", "t", 0), (3, 0, "user", "x", 0), (3, 0, "user", "x", 0),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place long")
    found = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(chat_format.turns_of_rows(table))).collect()}
    said = {1: [rows[1][2:4], rows[0][2:4]], 2: [("", ""), ("assistant", "")], None: [("a\nb", "t")], 3: [("user", "x")] * 2}
    for conv_id, turns in said.items():
        row = found[conv_id]
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    records_ = ['{"messages": [{"role": "user", "content": "a", "more": 1}]}', '{"prompt": "p", "completion": "c"}', '{"x": 1}', None]
    turns = chat_format.turns_of_records(spark.createDataFrame(list(enumerate(records_)), "k long, j string"), "k", "j")
    assert [(r["conv_id"], r["role"], r["text"]) for r in turns.orderBy("conv_id", "place").collect()] == [
        (0, "user", "a"), (1, "user", "p"), (1, "assistant", "c"), (2, None, '{"x": 1}'), (3, None, None),
    ]


@pytest.mark.parametrize("scores, label, bad", [(toxicity.toxicity_scores, "toxic", "vileword"), (quality.quality_scores, "quality", "vileword")])
def test_classifiers(spark, scores, label, bad):
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(240):
        marked = i % 2
        text = words(draw, 30) + ([bad] if marked else [])
        rows.append((i, " ".join(text)))
        labels.append((i, marked))
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (None, bad), (1, rows[1][1])], "doc_id long, text string")
    known = spark.createDataFrame(labels + [(5000, 1), (0, None), (None, 1)], f"doc_id long, {label} int")
    found = scores(docs, known).toPandas()
    assert len(found) == 244 and found.score.between(0, 1).all()
    truth = found.doc_id.map(dict(labels))
    fresh = found[found.held_out & truth.notna()]
    assert (fresh.predicted == truth[fresh.index]).mean() > 0.95
    assert all(row.held_out == (not pd.isna(row.doc_id) and zlib.crc32(str(int(row.doc_id)).encode()) % 3 == 1) for row in found.itertuples())
    assert found[found.doc_id == 900].score.iloc[0] == found[found.doc_id == 901].score.iloc[0]
    assert scores(docs.limit(0), known.limit(0)).count() == 0


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(3, "Hello there."), (1, None), (2, "x " * 9000), (2, "y"), (None, "z"), (4, "")], "doc_id long, text string")
    found = records.token_positions(docs, path, 2).orderBy("start").toPandas()
    assert [None if pd.isna(x) else x for x in found.doc_id] == [None, 1, 2, 2, 3, 4]
    assert found.start.tolist() == [0, *np.cumsum(found.n_tokens)[:-1]]
    assert found.n_tokens.iloc[1] == 1 and found.ids_crc32.iloc[1] == zlib.crc32(np.array([2], "<u4").tobytes())
    assert records.token_positions(docs.limit(0), path, 2).count() == 0


def test_encoded_documents_keep_their_columns(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, "a b", 3), (None, None, None), (1, "", 0)], "doc_id long, text string, n_tokens long")
    encoded = byte_bpe.encode_documents(docs, path, public_tokenizers.PATTERN)
    assert encoded.columns == [*docs.columns, "token_ids"]
    assert [r["token_ids"] for r in encoded.collect()] == [[64, 275], [], []]
    again = byte_bpe.encode_documents(encoded, path, public_tokenizers.PATTERN)
    assert again.columns == [*docs.columns, "token_ids_before", "token_ids"]
    digests = byte_bpe.round_trips(docs, path, public_tokenizers.PATTERN).collect()
    assert byte_bpe.round_trips(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r["n_tokens"], r["decoded_sha256"]) for r in digests] == [(2, hashlib.sha256(b"a b").hexdigest()), (0, empty), (0, empty)]


def test_pages(spark):
    shell = "<html><body><div><span>Shop of odds</span></div><div class=x>{}</div><p>Call us today</p></body></html>"
    pages = [(i, f"http://a.example/{i}", shell.format(f"<p>story number {i}</p>")) for i in range(8)]
    pages += [(20, "http://b.example/", shell.format("<p>alone</p>")), (21, None, None), (None, "odd", ""), (20, "http://b.example/", "<article>x<p>y &lt;z</article>")]
    found = html_template.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    texts = {}
    for row in found:
        assert row["n_chars"] == len(row["text"])
        texts.setdefault(row["page_id"], []).append(row["text"])
    assert [texts[i] for i in range(8)] == [[f"story number {i}"] for i in range(8)]
    assert sorted(texts[20]) == ["Shop of odds\nalone\nCall us today", "x\ny <z"] and texts[21] == [""] and texts[None] == [""]


def test_embeddings(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(40, 64))
    near = base + 0.15 * draw.normal(size=base.shape)
    vectors = np.concatenate([base, near, base[:3], 2 * base[:2]])
    rows = [(i, [float(np.float32(x)) for x in v], 1 if i % 40 < 30 else 2) for i, v in enumerate(vectors)]
    odd = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, [None] * 64, 1), (904, rows[0][1], None), (905, [], 1), (906, rows[0][1][:8], 1), (None, rows[0][1], 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    found = cap_filters.near_duplicates(table).collect()
    sound = [r for r in rows] + [odd[-1]]
    matrix = np.array([r[1] for r in sound])
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    same = np.equal.outer([r[2] for r in sound], [r[2] for r in sound])
    links = ((matrix @ matrix.T >= 0.93) & same).sum(axis=1) - 1
    expected = {r[0]: int(n) for r, n in zip(sound, links)} | {r[0]: 0 for r in odd[:-1]}
    assert {r["vec_id"]: r["n_links"] for r in found} == expected
    assert {r["vec_id"]: r["component_id"] for r in found}[40] == 0
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in found)
    assert cap_filters.near_duplicates(table.limit(0)).count() == 0


def test_links_of_vectors_of_any_length(spark):
    draw = np.random.default_rng(4)
    rows, expected = [], {}
    for size in (1, 3, 32, 128, 384, 768):
        base = draw.normal(size=(100, size))
        noise = draw.normal(size=base.shape) * np.linalg.norm(base, axis=1, keepdims=True) / np.sqrt(size)
        vectors = np.concatenate([base, base + 0.38 * noise]).astype(np.float32).astype(float)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        links = (unit @ unit.T >= 0.93).sum(axis=1) - 1
        for vector, count in zip(vectors, links):
            expected[len(rows)] = (size, int(count))
            rows.append((len(rows), vector.tolist(), 1))
    rows.append((len(rows), [1.0] * 96, 1))
    expected[len(rows) - 1] = (96, 0)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {r["vec_id"]: r["n_links"] for r in cap_filters.near_duplicates(table).collect()}
    for size in (1, 3, 32, 128, 384, 768):
        counts = [(found[i], count) for i, (length, count) in expected.items() if length == size]
        assert all(here <= count for here, count in counts)
        assert sum(here for here, _ in counts) >= 0.98 * sum(count for _, count in counts) > 0
    assert found[len(rows) - 1] == 0


@pytest.mark.parametrize("threshold", [0.6, 0.93, 0.99])
@pytest.mark.parametrize("size", [8, 64, 200])
def test_planned_codes_miss_few_pairs(size, threshold):
    draw = np.random.default_rng(size)
    one = draw.normal(size=(1000, size))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other = draw.normal(size=one.shape)
    other -= (one * other).sum(axis=1, keepdims=True) * one
    other = threshold * one + np.sqrt(1 - threshold**2) * other / np.linalg.norm(other, axis=1, keepdims=True)
    cap, codes = cap_filters.plan(size, threshold)
    together = np.zeros(1000, bool) if codes else np.ones(1000, bool)
    for code in range(codes):
        passed = [set(zip(*map(np.ndarray.tolist, cap_filters.decode(side, code, cap)))) for side in (one, other)]
        together[[row for row, _ in passed[0] & passed[1]]] = True
    assert together.mean() >= 0.99


@pytest.mark.parametrize("judge, label", [(toxicity.judge_toxicity, "toxic"), (quality.judge_quality, "quality")])
def test_scores_mean_the_same_if_a_class_is_cut(spark, judge, label):
    draw = random.Random(8)
    rows, labels = [], []
    for i in range(4000):
        marked = int(i % 10 == 0)
        sign = ["vileword"] if draw.random() < (0.7 if marked else 0.1) else []
        rows += [(i, text := " ".join(words(draw, 12) + sign)), (10000 + i, text)]
        labels += [(i, marked), *([] if marked else [(10000 + i, marked)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, f"doc_id long, {label} int")
    means = [judge(docs, docs, known, Settings(per_class=size)).toPandas().score.mean() for size in (5000, 250)]
    assert all(0.03 < mean < 0.2 for mean in means), means


def test_repeated_boxes_inside_articles_are_template(spark):
    shell = "<html><body><p>Top</p><article><div class=x1>Ask our team</div><h1>Title {0}</h1><p>told {0}</p><p>as often said</p>{1}</article></body></html>"
    pages = [(i, f"http://a.example/{i}", shell.format(i, "<p>more</p>" * (i % 3))) for i in range(9)]
    copy = "<article><h1>Same</h1><p>the same story</p></article>"
    pages += [(20 + i, f"http://b.example/{i}", copy) for i in range(9)]
    found = html_template.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    texts = {r["page_id"]: r["text"] for r in found}
    for i in range(9):
        assert texts[i] == "\n".join([f"Title {i}", f"told {i}", "as often said", *["more"] * (i % 3)])
        assert texts[20 + i] == "Same\nthe same story"


def test_lists_of_mixed_elements_are_not_read_by_the_first(spark):
    mixed = '{"messages": [{"role": "user", "content": "a"}, {"from": "human", "value": "b"}]}'
    plain = '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}'
    table = spark.createDataFrame([(0, mixed), (1, plain), (2, '{"messages": []}')], "k long, j string")
    found = chat_format.turns_of_records(table, "k", "j").orderBy("conv_id", "place").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in found] == [
        (0, None, mixed), (1, "user", "a"), (1, "assistant", "b"), (2, None, '{"messages": []}'),
    ]
