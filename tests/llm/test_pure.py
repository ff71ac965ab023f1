"""What runs inside tasks, against plain versions of it."""

from __future__ import annotations

import heapq
import random
import re
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from cordwood.llm import (
    byte_bpe,
    cap_filters,
    chat_format,
    divergence,
    html_template,
    linear,
    ngram_join,
    prefix_counts,
    quality,
    records,
    repair,
    shingles,
    toxicity,
)

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ODD = "ab 'slrevmdAB.,!|$ \n\té中😀0123\x1c İΣςſ<|endoftext|>́"


@pytest.fixture(scope="module")
def tokenizer():
    return byte_bpe.Tokenizer(RANKS, public_tokenizers.PATTERN)


def odd_texts(count):
    draw = random.Random(5)
    return ["".join(draw.choice(ODD) for _ in range(draw.randint(0, 50))) for _ in range(count)]


def test_the_perfect_hash_has_one_slot_per_token(tokenizer):
    assert sorted(tokenizer.whole.slots) == list(range(len(RANKS)))
    assert all(tokenizer.rank(token) == rank for token, rank in RANKS.items())
    assert tokenizer.rank(b"no such token at all") is None


def test_byte_bpe_is_that_of_the_library(tokenizer):
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
    )
    encode, decode = byte_bpe.encoder(tokenizer), byte_bpe.Decoder(RANKS).decode
    for text in ["", " ", "x" * 5000, *odd_texts(1500)]:
        ids = encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert decode(ids).decode() == text


@pytest.mark.parametrize(
    "bounds",
    [{}, {"LONG_TEXT": 40, "TOGETHER": 90, "CELLS": 20}, {"TOGETHER": 60, "CACHED_TOKENS": 9, "CACHED_LENGTH": 2, "WIDTHS": (2, 5)}],
)
def test_texts_encoded_together_are_those_of_the_library(monkeypatch, tokenizer, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(byte_bpe, name, value)
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
    )
    texts = ["", "x" * 300, *odd_texts(700), "", "\u4e2d" * 70 + " a", "ofanerhand " * 9, *odd_texts(30)]
    found = list(byte_bpe.Encoder(tokenizer).encode_all(iter(texts)))
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [library.encode_ordinary(text) for text in texts]


def test_pieces_merged_side_by_side_are_those_of_the_heap():
    draw = random.Random(6)
    for _ in range(40):  # ranks in no order that training could give
        tokens = {"".join(draw.choice("abc") for _ in range(draw.randint(2, 6))).encode() for _ in range(60)}
        ranks = [*map(bytes, zip(range(256))), *tokens]
        draw.shuffle(ranks)
        own = byte_bpe.Tokenizer({token: rank for rank, token in enumerate(ranks)}, public_tokenizers.PATTERN)
        pieces = ["".join(draw.choice("abcd") for _ in range(draw.randint(1, 24))).encode() for _ in range(80)]
        ids, counts = own.merge_side_by_side(pieces, 24)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [part.tolist() for part in parts] == [own.merge(piece) for piece in pieces]


def test_only_long_pieces_are_merged_one_at_a_time(monkeypatch, tokenizer):
    alone, merge = [], tokenizer.merge
    monkeypatch.setattr(tokenizer, "merge", lambda piece: alone.append(piece) or merge(piece))
    encode = byte_bpe.encoder(tokenizer)
    for text in odd_texts(300):
        encode(text + " " + "qz" * 40)
    assert alone and min(map(len, alone)) > byte_bpe.WIDTHS[-1]


def test_a_byte_without_a_token_is_an_error():
    own = byte_bpe.Tokenizer({b"a": 0, b"bc": 1, b"abc": 2}, public_tokenizers.PATTERN)
    assert np.frombuffer(byte_bpe.encoder(own)("abcbca"), "<u4").tolist() == [2, 1, 0]
    with pytest.raises(ValueError):
        byte_bpe.encoder(own)("ab")


@pytest.mark.parametrize("bounds", [{}, {"LONG_TEXT": 20, "WORDS": 3, "CACHED_WORDS": 50, "CACHED_UNITS": 20}])
def test_word_ids_are_those_of_the_library(monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(records, name, value)
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as lines:
        definition = lines.read()
    library = Library.from_str(definition)
    letters = [
        chr(c) for c in range(0x30000) if unicodedata.category(chr(c))[0] in "LM" and (c < 0x600 or unicodedata.decomposition(chr(c)))
    ]
    texts = ["", "  ", "a <|endoftext|> b", "x<|startoftext|>y.", "<|endoftext|", "a\x1cb c\x1d", *odd_texts(1500)]
    texts += [" ".join(f"{before}{letter}{mark}" for before in ("", "a", "\u09b9") for mark in ".,!?-") for letter in letters]
    for width in ("<u2", "<u4"):
        words = records.WordIds(definition, width)
        for text in texts:
            assert np.frombuffer(words.encode(text), width).tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.fixture(scope="module")
def pieces():
    with open(PIECE_MODEL, "rb") as model:
        return prefix_counts.Pieces(model.read())


@pytest.mark.parametrize("bounds", [{}, {"LONG_TEXT": 10, "CACHED_CHUNKS": 20, "CACHED_PAIRS": 30}])
def test_prefix_counts_are_those_of_the_library(monkeypatch, pieces, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(prefix_counts, name, value)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    tables = prefix_counts.Tables(pieces)
    draw = random.Random(7)
    odd = ODD + "\u2581  \u00b2\u2168\u7684\u4e00the"
    texts = ["", " ", "a" * 300, " " * 300, "\u7684" * 99, "<s> </s><unk><0x0A>\x00"]
    texts += ["".join(draw.choice(odd) for _ in range(draw.randint(0, 40))) for _ in range(800)]
    for text in texts:
        counts = tables.prefixes(text)
        assert counts.tolist() == [len(library.encode(text[:k])) for k in range(len(text) + 1)], text
        assert tables.count(text) == counts[-1]


def test_neighbours_are_those_of_plain_merging(pieces):
    draw = random.Random(8)
    for _ in range(3000):
        left, right = draw.randrange(len(pieces.texts)), draw.randrange(len(pieces.texts))
        a, b = pieces.texts[left], pieces.texts[right]
        *_, (parts, _) = pieces._steps(a + b)
        assert pieces.may_follow(left, right) == (parts == [a, b])


def cheapest_edits(codes):
    """The least (cost, edits) of all ways to repair some rows, by Dijkstra's method."""
    done, waiting, found = set(), [(0, "", 0, repair.START)], []
    while waiting:
        cost, edits, at, state = heapq.heappop(waiting)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(codes) and state in (repair.START, repair.ASSISTANT):
            found.append((cost, edits))
        ahead = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        heapq.heappush(waiting, (cost + 3, edits + "I", at, ahead))
        if at < len(codes):
            initial, fault = codes[at] % 4, codes[at] // 4
            heapq.heappush(waiting, (cost + 4, edits + "D", at + 1, state))
            if fault in (0, 3):
                if (initial, state) == (1, 0) or initial == ahead:
                    heapq.heappush(waiting, (cost + fault, edits + "K", at + 1, initial))
                heapq.heappush(waiting, (cost + 3 + fault, edits + "R", at + 1, ahead))
    return min(found)


@given(st.lists(st.integers(0, 15), max_size=12), st.integers(0, 12))
@settings(max_examples=600, deadline=None)
def test_walks_are_the_least_of_the_cheapest(rows, cut):
    codes = bytes(rows)
    cost, edits = cheapest_edits(codes)
    assert "".join(repair.walk(codes, repair.FINAL, repair.START)[0]) == edits
    assert repair.back_over(codes, repair.FINAL)[repair.START] == cost
    parts = [codes[:cut], codes[cut:]]
    behind = repair._behind({"segments": [{"costs": repair.table_of(part)} for part in parts]})
    exits = [[repair.walk(part, tuple(left), state, False)[1] for state in range(4)] for part, left in zip(parts, behind)]
    entries = repair._entries({"segments": [{"exits": x} for x in exits]})
    written = [repair.walk(parts[k], tuple(behind[k]), entries[k], k == 1)[0] for k in range(2)]
    assert "".join(written[0] + written[1]) == edits


@pytest.mark.parametrize("piece", [1 << 20, 8])
def test_terms_are_those_of_the_pattern(monkeypatch, piece):
    monkeypatch.setattr(divergence, "PIECE_BYTES", piece)
    for text in ["", "a", "Zürich-ÄB c2d", "x" * 50 + " y", *odd_texts(300)]:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        terms = [term.decode() for part in divergence._term_pieces(text.encode()) for term in part]
        assert terms == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)


@given(st.binary(max_size=200))
@settings(max_examples=50, deadline=None)
def test_records_round_trip_and_damage_is_seen(payload):
    framed = records.frame(payload)
    assert records.unframe(framed[:12], framed[12:]) == payload
    if payload:
        broken = bytearray(framed)
        broken[12] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(broken[:12]), bytes(broken[12:]))


@pytest.mark.parametrize("piece", [1 << 20, 16])
def test_shingle_sets_have_the_size_of_plain_ones(monkeypatch, piece):
    monkeypatch.setattr(shingles, "PIECE_BYTES", piece)
    texts = [None, "", " \n", "One", "a b c", "A b c d", "a b c d", "a\tb c d e a b c d e é É"] + odd_texts(100)
    found = list(shingles.shingle_sets(pa.array(texts), 4))
    plain = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        plain.append({tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set())
    assert [len(x) for x in found] == [len(x) for x in plain]
    assert [found[5].tolist()] == [found[6].tolist()]
    assert shingles.set_fingerprint(found[5]) == shingles.set_fingerprint(found[6])


@pytest.mark.parametrize("extract", [toxicity.CHARACTERS, quality.WORDS])
def test_features_of_a_text_do_not_depend_on_its_pieces(monkeypatch, extract):
    draw = random.Random(4)
    words = ["abcdefgh", "é中😀", "Word,", "x" * 90, "12", "rep", "\n", "Ünd"]
    texts = [None, "", "abcdefgh " * 40, "abcd", "é" * 200, "rep " * 30 + "x", "x" * 500, "😀中" * 60]
    texts += [" ".join(draw.choice(words) for _ in range(draw.randint(0, 80))) for _ in range(30)]
    texts = pa.array(texts)
    monkeypatch.setattr(linear, "PIECE_BYTES", 1 << 30)
    whole = [x.tolist() for x in linear.text_features(texts, extract, None)]
    for size in (8, 64, 256, 1 << 18):
        monkeypatch.setattr(linear, "PIECE_BYTES", size)
        assert [x.tolist() for x in linear.text_features(texts, extract, None)] == whole


def test_character_ngrams_are_those_of_characters():
    texts = ["", "ÄÖ ab\tC", "中文字符😀", "ab", *odd_texts(50)]
    found = list(linear.text_features(pa.array(texts), toxicity.CHARACTERS, None))
    for text, hashes in zip(texts, found):
        folded = "".join(" " if c in "\t\n\x0b\x0c\r" else c.lower() if ord(c) < 0x800 and len(c.lower()) == 1 else c for c in text)
        plain = {folded[i : i + n] for n in toxicity.SIZES for i in range(len(folded) - n + 1)}
        assert len(hashes) >= 0.99 * len(plain) - 1 and len(hashes) <= len(plain)
        if plain:
            same = next(linear.text_features(pa.array([folded]), toxicity.CHARACTERS, None))
            assert same.tolist() == hashes.tolist()


def test_dual_coordinate_descent_separates():
    rows = [np.array(x) for x in ([0, 1], [0, 2], [3, 1], [3, 2])]
    signs = np.array([1.0, 1.0, -1.0, -1.0])
    weights, bias = linear.dual_coordinate_descent(rows, signs, np.ones(4), linear.Settings())
    assert all(sign * (weights[row].sum() + bias) > 0 for row, sign in zip(rows, signs))


def test_list_decoding_finds_all_directions_over_the_cap():
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(20, 10))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rotation, words = cap_filters._code(10, 0)
    turned = vectors @ rotation
    sums = (turned[:, :5] @ words[0].T)[:, :, None] + (turned[:, 5:] @ words[1].T)[:, None, :]
    row, first, second = np.nonzero(sums / np.sqrt(2) >= 0.4)
    rows, number = cap_filters.decode(vectors, 0)
    assert set(zip(rows, number)) == set(zip(row, first * cap_filters.WORDS + second))


def test_escaped_control_strings_come_back():
    for text in ("", "\\", "\\n", "<|end|>\n", "</s>[INST] ok [/INST]", "\\\\<\\|", "<<SYS>>"):
        escaped = text.replace("\\", "\\\\")
        for control in chat_format.CONTROL:
            escaped = escaped.replace(control, f"{control[0]}\\{control[1:]}")
        assert "<|" not in escaped and chat_format.unescape(escaped) == text


def test_page_parts():
    page = (
        "<html><body><header>Top</header><div id=sidebar><p>x</div><div class=main-content><h2>A &amp; B</h2>"
        "<p>one<p class=notice>bad<p>two <i>it</i>alic<br>next</p><div class='comments'><p>c</p></div>"
        "<form>f<input name=\"q></form></div><script>var t='</p>';</script><!-- ad --><footer>f"
    )
    said = [value for kind, value, _, free in html_template.tokens(page) if kind == "text" and free]
    assert said == ["A & B", "one", "two italic next"]


def test_names_inside_articles_rule_out_only_what_they_say():
    page = (
        "<body><div class='side-note'>outside</div><article><div class='article-head'><h1>T</h1></div>"
        "<h2 id='related-work'>R</h2><p id='notice-1'>N</p><section class='search-results-study'><p>S</p></section>"
        "<p class='side-note'>X</p><div class='comments'><p>c</p></div><div class='related-links'>l</div>"
        "<div class='share-bar'>s</div><ul id='comments'><li>z</li></ul><div class='site-notice box'>q</div>"
        "<div class='ad-slot'>a</div><aside>b</aside></article>"
    )
    said = [value for kind, value, _, free in html_template.tokens(page) if kind == "text" and free]
    assert said == ["T", "R", "N", "S", "X"]


def test_sets_of_near_copies_leave_in_small_batches():
    texts = pa.array([f"a b c d e {i}" for i in range(1200)], pa.string())
    found = list(ngram_join._whole_sets(4)(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])))
    assert sum(batch.num_rows for batch in found) == 1200
    assert max(batch.num_rows for batch in found) <= 500
    for run in (ngram_join._describe(4, 0.25), ngram_join._sightings(4, 0.25), ngram_join._whole_sets(4)):
        assert run.__name__ == "tidied"  # hands freed memory back


def test_ascii_words_need_no_pattern(monkeypatch):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as lines:
        words = records.WordIds(lines.read(), "<u2")
    text = "The quick, BROWN fox!! jumps; over... lazy? dogs"
    expected = words.whole(text)

    def refused(word):
        raise AssertionError(word)

    monkeypatch.setattr(records, "_unit", refused)
    assert words.encode(text) == expected
