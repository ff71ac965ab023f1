"""Token counts, repairs and divergences on Spark against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece

from cordwood.llm import divergence, prefix_counts, repair
from pyspark.sql import functions as F
from tests.llm.test_pure import cheapest_edits

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_token_counts(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    texts = ["one two", None, "", " ", "é中😀 <s>", "word " * 30_000, "one two"]
    docs = spark.createDataFrame([(i or None, text, 5) for i, text in enumerate(texts)], "doc_id long, text string, n_tokens long")
    found = prefix_counts.count_tokens(docs, PIECE_MODEL, 4096).collect()
    expected = [(i or None, len((x or "").encode()), len(library.encode(x or "")), len(library.encode(x or "")) > 4096) for i, x in enumerate(texts)]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert prefix_counts.count_tokens(docs.limit(0), PIECE_MODEL, 1).count() == 0


def test_budgets_need_the_stored_counts_alone(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    texts = ["thing and other things", "中文 的", None, "", "aaaaaaaaa bbb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = prefix_counts.with_prefix_counts(docs, PIECE_MODEL)
    with pytest.raises(ValueError):
        prefix_counts.with_prefix_counts(stored, PIECE_MODEL)
    for row in stored.collect():
        text = row["text"] or ""
        assert row["prefix_counts"] == [len(library.encode(text[:k])) for k in range(len(text) + 1)]
    for budget in (0, 1, 3, 100):
        for row in prefix_counts.truncated(stored, budget).collect():
            whole = texts[row["doc_id"]]
            fits = [k for k in range(len(whole or "") + 1) if len(library.encode((whole or "")[:k])) <= budget]
            assert row["text"] == (None if whole is None else whole[: max(fits)])
    added = stored.where("doc_id = 0").select(prefix_counts.tokens_of_slice(F.lit(5), F.lit(16)).alias("n")).first()["n"]
    assert added == len(library.encode(texts[0][:16])) - len(library.encode(texts[0][:5]))


def plain_repair(rows):
    """Summaries and repaired turns of rows (conv_id, turn, role, text), damaged first."""
    conversations = defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        conversations[conv_id] += [(turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    found = {}
    for conv_id, said in conversations.items():
        said.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).digest()))
        codes, seen = [], set()
        for _, role, text in said:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 1 if not last else 2 if (role, text) in seen else 0 if last[-1] in ".!?" else 3
            seen.add((role, text))
            codes.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) + 4 * fault)
        cost, audit = cheapest_edits(codes)
        turns, last, at = [], "", 0
        for letter in audit:
            ahead = "assistant" if last == "u" else "user"
            role, text = (ahead, "") if letter == "I" else said[at][1:]
            at += letter != "I"
            if letter != "D":
                turns.append((letter, ahead if letter in "IR" else role, text))
                last = turns[-1][1][0]
        numbers = [turn for turn, _, _ in said if turn is not None]
        found[conv_id] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *(sum(code // 4 == fault for code in codes) for fault in (1, 2, 3)),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:])),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in turns).encode()).hexdigest(), turns,
        )
    return found


@pytest.fixture(scope="module")
def conversations():
    draw = random.Random(12)
    texts = ["Yes.", "no", None, "", " \n", "Why? ", "Ünd\n", "longer " * 400 + "!", "same"]
    rows = []
    for conv_id in [None, *range(60)]:
        for _ in range(draw.randint(1, 9)):
            turn = draw.choice([None, *range(7), -3])
            rows.append((conv_id, turn, draw.choice(["user", "assistant", "system", None, "", "tool", "user", "assistant"]), draw.choice(texts)))
    rows += [(100, i // 2, ("user", "assistant")[i % 2], f"said {i % 90}.") for i in range(400)]
    return rows + [(conv_id, 1, "user", "Dropped.") for conv_id in range(200, 240)]


@pytest.mark.parametrize("segment_rows", [1, 7, 1 << 20])
def test_repairs(spark, conversations, segment_rows):
    table = spark.createDataFrame([(*row, "x", 3) for row in conversations], "conv_id long, turn long, role string, text string, audit string, copies int")
    rows = repair.damaged(table)
    plain = plain_repair(conversations)
    found = repair.repair_summaries(rows, segment_rows).collect()
    assert len(found) == len(plain) and any(not x[6] for x in plain.values())
    for row in found:
        assert tuple(row)[1:] == plain[row["conv_id"]][:-1], row["conv_id"]
    turns = defaultdict(list)
    for row in repair.repaired_turns(rows, segment_rows).orderBy("conv_id", "place").collect():
        turns[row["conv_id"]].append((row["edit"], row["role"], row["text"]))
    assert dict(turns) == {conv_id: x[-1] for conv_id, x in plain.items() if x[-1]}


def test_nothing_to_repair(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair.repair_summaries(repair.damaged(empty)).count() == 0
    assert repair.repaired_turns(repair.damaged(empty)).count() == 0


def plain_divergence(rows, ranks):
    scale, langs, documents, groups = 10**9, defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered))
        langs[lang or ""].update(terms)
        documents[lang or ""].update(terms.keys())
        groups[lang or "", source or ""].update(terms)
    found = set()
    for (lang, source), counts in groups.items():
        kept = [term for term, n in documents[lang].items() if n >= 3]

        def shares(of):
            total = sum(of[term] for term in kept) + len(kept)
            return {term: 1 + scale * (of[term] + 1) // total for term in kept}

        p = shares(counts)
        others = {other: shares(groups[lang, other]) for x, other in groups if x == lang and other != source}
        pairs = [(sum((p[t] - q[t]) ** 2 // q[t] for t in kept), other) for other, q in others.items()]
        q = shares(langs[lang])
        terms = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if counts[t] and p[t] > q[t]]
        for part, values, last in (("pair", pairs, None), ("term", terms, ranks)):
            ordered = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:last]
            found |= {(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ordered)}
    return found


@pytest.mark.parametrize("ranks, terms_at_once", [(200, 200_000), (3, 5)])
def test_divergence(spark, monkeypatch, ranks, terms_at_once):
    monkeypatch.setattr(divergence, "TABLE_TERMS", terms_at_once)
    draw = random.Random(9)
    words = ["Alpha", "beta", "ÄRGER", "ärger", "中文", "a-b", "x1y", "😀"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [
        (" ".join(draw.choices(words, k=draw.randint(0, 25))), draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "s3", None, "Ü"]))
        for _ in range(120)
    ]
    rows += [(None, "en", "silent"), ("", "xx", "only"), ("rare", "xx", "other"), ("same same", "en", "s1"), ("same same", "en", "s1"), ("Same", "en", "s2")]
    rows += [("beta " * 3000, "de", "s1")]
    docs = spark.createDataFrame([(*row, 1, "t") for row in rows], "text string, lang string, source string, n int, term string")
    found = divergence.source_divergence(docs, ranks=ranks)
    assert found.schema["value"].dataType.simpleString() == "bigint" and found.schema["rank"].dataType.simpleString() == "int"
    assert {tuple(row) for row in found.collect()} == plain_divergence(rows, ranks)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_terms_and_their_totals_take_one_shuffle(spark, monkeypatch):
    stored = {}

    def store(self, df, name):
        stored[name] = df
        return df

    monkeypatch.setattr(divergence.Scratch, "store", store)
    rows = [("one two", "en", "s1"), ("one two", "en", "s2"), ("one", "en", "s2"), ("two", "de", "s1")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    kept = divergence.kept_terms(docs)
    assert {tuple(row) for row in kept.collect()} == {("en", "s1", "one", 1, 3), ("en", "s2", "one", 2, 3)}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert list(stored) == ["kept"] and plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
