"""Quality classifier: naive Bayes support vectors on n-grams of words, word shapes and repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordwood.llm.common import held_out, making_room
from cordwood.llm.linear import HASH_BITS, Extractor, Settings, fit, score
from cordwood.llm.shingles import _SEPARATOR, _words, mix

THRESHOLD = 0.5
SHAPE_WORDS = 3
REPEATS = 8

# Character classes: upper case, lower case (with all letters beyond ASCII), digits; every other
# character is a class by itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[48:58] = 48


def _shaped(data: np.ndarray) -> np.ndarray:
    """The bytes as classes; white space stays."""
    return np.where(_SEPARATOR[data], data, _CLASS[data])


def _index(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def word_ngrams(
    data: np.ndarray, begins: np.ndarray, keep: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, n-grams of word shapes, and runs of a repeated word up to ``REPEATS``."""
    words, before = _words(data, begins)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shape = _shaped(data)
    fresh = np.ones(len(shape), bool)
    fresh[1:] = shape[1:] != shape[:-1]
    fresh[begins[begins < len(shape)]] = True
    placed = np.cumsum(fresh) - fresh  # kept bytes before each byte
    starts = np.where(begins < len(shape), placed[np.minimum(begins, len(shape) - 1)], int(fresh.sum()))
    shapes, _ = _words(shape[fresh], starts)
    owner = np.searchsorted(before, np.arange(len(words)), side="right") - 1
    texts, hashed = [owner], [_index(mix(words ^ np.uint64(1)))]
    state = np.zeros(len(shapes), np.uint64)
    for size in range(1, SHAPE_WORDS + 1):
        if size > len(shapes):
            break
        state = mix(state[: len(shapes) - size + 1] * np.uint64(0xD6E8FEB86659FD93) ^ shapes[size - 1 :])
        inside = owner[: len(state)] == owner[size - 1 :]
        texts.append(owner[: len(state)][inside])
        hashed.append(_index(mix(state ^ np.uint64(size + 1)))[inside])
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    run = same
    for size in range(1, REPEATS + 1):
        at = np.flatnonzero(run)
        if not len(at):
            break
        texts.append(owner[at])
        hashed.append(np.full(len(at), int(_index(mix(np.array([1000 + size], np.uint64)))[0]), np.int64))
        run = np.append(False, run[:-1]) & same
    texts, hashed = np.concatenate(texts), np.concatenate(hashed)
    if keep is not None:
        wanted = keep[hashed]
        texts, hashed = texts[wanted], hashed[wanted]
    return texts, hashed


def word_pieces(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Pieces of whole words, each beginning ``REPEATS`` words before the end of the one before.

    No feature needs more words than that and one more, so each lies in some piece; a piece grows
    until it holds enough words to move on.
    """
    at = 0
    while True:
        end = at
        while True:
            end = min(end + size, len(data))
            while end < len(data) and not _SEPARATOR[data[end - 1]]:
                gap = np.flatnonzero(_SEPARATOR[data[end : end + size]])
                end = end + int(gap[0]) + 1 if len(gap) else min(end + size, len(data))
            inside = ~_SEPARATOR[data[at:end]]
            starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
            if end == len(data) or len(starts) > REPEATS:
                break
        yield data[at:end]
        if end == len(data):
            return
        at += int(starts[-REPEATS])


WORDS = Extractor(word_ngrams, word_pieces)


def judge_quality(
    docs: DataFrame,
    learnt_from: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    threshold: float = THRESHOLD,
) -> DataFrame:
    """All rows and columns of ``docs`` with their ``score`` and ``predicted``.

    ``labels.quality`` of the documents ``learnt_from`` is learnt from at most
    ``settings.per_class`` rows of each class that are not held out; null labels and labels without
    a document teach nothing. Only ``text`` of ``docs`` is read; a column of it that is called score
    or predicted comes back as ``<name>_before``. Null and empty texts score alike; a repeated row is
    scored again; an empty table gives no rows.
    """
    model = fit(learnt_from, labels, "quality", WORDS, settings)
    judged = (F.col("score") >= threshold).cast("int").alias("predicted")
    return score(making_room(docs, "score", "predicted"), model, WORDS).select("*", judged)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all ``docs``: doc_id, held_out (false without an id), score, predicted."""
    judged = judge_quality(docs.select("doc_id", "text"), docs, labels)
    return judged.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
