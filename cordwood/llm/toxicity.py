"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordwood.llm.common import held_out, making_room
from cordwood.llm.linear import HASH_BITS, Extractor, Settings, fit, score

SIZES = (3, 4, 5, 6, 7)
THRESHOLD = 0.7
# Toxic words may be in few labelled texts.
SETTINGS = Settings(max_features=60_000, min_texts=3)

# Letters of one or two bytes in lower case, white space as one blank.
_FOLD = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x800)], np.uint32)
_FOLD[[9, 10, 11, 12, 13]] = 32


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of UTF-8 bytes, and where each begins."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    if len(starts) == len(data):
        return _FOLD[data], starts
    sizes = np.diff(starts, append=len(data))
    points = data[starts].astype(np.uint32)
    points &= np.array([0, 127, 31, 15, 7], np.uint32)[np.minimum(sizes, 4)]
    for k in range(1, 4):
        longer = np.flatnonzero(sizes > k)
        points[longer] = points[longer] << np.uint32(6) | (data[starts[longer] + k] & 63)
    low = np.flatnonzero(points < len(_FOLD))
    points[low] = _FOLD[points[low]]
    return points, starts


def character_ngrams(
    data: np.ndarray, begins: np.ndarray, keep: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of lower-cased characters; none reaches from one text into the next."""
    letters, starts = _characters(data)
    begins = np.searchsorted(starts, begins)
    ends = np.append(begins[1:], len(letters))
    texts, hashed = [], []
    state = np.zeros(len(letters), np.uint32)
    for size in range(1, max(SIZES) + 1):
        if size > len(letters):
            break
        state = state[: len(letters) - size + 1] * np.uint32(0x01000193)
        state += letters[size - 1 :] * np.uint32(0x9E3779B1) + np.uint32(size)
        if size not in SIZES:
            continue
        spread = state ^ (state >> np.uint32(15))
        spread *= np.uint32(0x2C1B3C6D)
        spread ^= spread >> np.uint32(12)
        spread *= np.uint32(0x297A2D39)
        index = spread >> np.uint32(32 - HASH_BITS)
        at = np.arange(len(index)) if keep is None else np.flatnonzero(keep[index])
        owner = np.searchsorted(begins, at, side="right") - 1
        inside = at + size <= ends[owner]
        texts.append(owner[inside])
        hashed.append(index[at[inside]].astype(np.int64))
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(texts), np.concatenate(hashed)


def character_pieces(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Pieces of whole characters that share the longest n-gram's length with the next one."""

    def boundary(at: int) -> int:
        while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
            at -= 1
        return at

    at = 0
    while True:
        end = boundary(min(at + size + 8 * max(SIZES), len(data)))
        yield data[at:end]
        if end == len(data):
            return
        at = boundary(end - 4 * max(SIZES))


CHARACTERS = Extractor(character_ngrams, character_pieces)


def judge_toxicity(
    docs: DataFrame,
    learnt_from: DataFrame,
    labels: DataFrame,
    settings: Settings = SETTINGS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """All rows and columns of ``docs`` with their ``score`` and ``predicted``.

    ``labels.toxic`` of the documents ``learnt_from`` is learnt from at most
    ``settings.per_class`` rows of each class that are not held out; null labels and labels without
    a document teach nothing. Only ``text`` of ``docs`` is read; a column of it that is called score
    or predicted comes back as ``<name>_before``. Null and empty texts score alike; a repeated row is
    scored again; an empty table gives no rows.
    """
    model = fit(learnt_from, labels, "toxic", CHARACTERS, settings)
    judged = (F.col("score") >= threshold).cast("int").alias("predicted")
    return score(making_room(docs, "score", "predicted"), model, CHARACTERS).select("*", judged)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all ``docs``: doc_id, held_out (false without an id), score, predicted."""
    judged = judge_toxicity(docs.select("doc_id", "text"), docs, labels)
    return judged.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
