"""Linear text classifiers on hashed n-gram indicators scaled by naive Bayes log-count ratios.

Fitting takes a bounded sample of labelled texts; counting and feature extraction run on Spark, the
fit itself on the driver over at most ``2 * per_class`` sparse rows and ``max_features`` columns.
Sampled rows are weighted by what their class has in all labelled texts, so that scores mean the
same whether the bound cuts a class or not.
Scoring is one pass over all texts with a weight table of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cordwood.llm.common import Scratch, bounded, held_out, tidy
from cordwood.llm.shingles import text_bytes

HASH_BITS = 20
PIECE_BYTES = 1 << 17


@dataclass(frozen=True)
class Extractor:
    """How texts become features.

    ``features`` takes bytes, where each text begins, and a table that says which hashes matter (None
    for all); it gives pairs (text number, hashed n-gram), repeats allowed. ``pieces`` cuts a long
    text into pieces of about so many bytes whose features together are those of the whole text.
    """

    features: Callable[[np.ndarray, np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray]]
    pieces: Callable[[np.ndarray, int], Iterator[np.ndarray]]


@dataclass(frozen=True)
class Settings:
    """Bounds and constants of a fit; all are parameters of the operators."""

    per_class: int = 4000
    max_features: int = 20_000
    min_texts: int = 4
    smoothing: float = 1.0
    penalty: float = 1.0
    interpolation: float = 0.9
    epochs: int = 12


@dataclass(frozen=True)
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def text_features(
    column: pa.Array, extract: Extractor, keep: np.ndarray | None
) -> Iterator[np.ndarray]:
    """For each text in turn its distinct hashed n-grams, whole texts of any length."""
    data, offsets = text_bytes(column)
    rows, row = len(offsets) - 1, 0
    while row < rows:
        size = int(offsets[row + 1] - offsets[row])
        if size > PIECE_BYTES:
            found = np.zeros(0, np.int64)
            for piece in extract.pieces(data[offsets[row] : offsets[row + 1]], PIECE_BYTES):
                found = np.union1d(found, extract.features(piece, np.zeros(1, np.int64), keep)[1])
            yield found
            row += 1
            continue
        end = int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, side="right")) - 1
        end = max(row + 1, min(end, rows))
        texts, hashed = extract.features(
            data[offsets[row] : offsets[end]], offsets[row:end] - offsets[row], keep
        )
        both = np.unique((texts.astype(np.int64) << 32) | hashed)
        owner = both >> 32
        bounds = np.searchsorted(owner, np.arange(end - row + 1))
        values = both & 0xFFFFFFFF
        for k in range(end - row):
            yield values[bounds[k] : bounds[k + 1]]
        row = end


def _usable(labels: DataFrame, label: str) -> DataFrame:
    """The labels that may be learnt from, each once."""
    return (
        labels.select("doc_id", F.col(label).alias("label"))
        .where(F.col("doc_id").isNotNull() & ~held_out("doc_id") & F.col("label").isin(0, 1))
        .distinct()
    )


def _class_totals(
    docs: DataFrame, labels: DataFrame, label: str, settings: Settings, sampled: dict[int, int]
) -> dict[int, int]:
    """Distinct labelled texts of each class in all of ``docs``; counted only if a class was cut."""
    usable = _usable(labels, label)
    sizes = dict(usable.groupBy("label").count().collect())
    if max(sizes.values()) <= settings.per_class:
        return sampled
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")).distinct()
    return dict(
        texts.join(usable, "doc_id").select("label", "text_key").distinct().groupBy("label").count().collect()
    )


def _sample(docs: DataFrame, labels: DataFrame, label: str, settings: Settings) -> DataFrame:
    """At most ``per_class`` labelled rows of each class, the first by a hash of their ids."""
    usable = _usable(labels, label)
    chosen = None
    for value in (0, 1):
        one = (
            usable.where(F.col("label") == value)
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(settings.per_class)
        )
        chosen = one if chosen is None else chosen.unionByName(one)
    # At most 2 * per_class rows of two numbers: a proven bound.
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .select(F.col("label").cast("int").alias("label"), F.coalesce("text", F.lit("")).alias("text"))
        .dropDuplicates()
    )


def _counting(extract: Extractor):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << HASH_BITS), np.int32)
        for batch in batches:
            labels = batch.column(0).to_numpy(zero_copy_only=False)
            for label, found in zip(labels, text_features(batch.column(1), extract, None)):
                counts[int(label), found] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(counts[1, at]), pa.array(counts[0, at])],
            names=["feature", "ones", "zeros"],
        )

    return tidy(run)


def _restricted(extract: Extractor, features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(1 << HASH_BITS, bool)
        keep[features] = True
        for batch in batches:
            rows = [np.searchsorted(features, x).astype(np.int32) for x in text_features(batch.column(1), extract, keep)]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            values = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))],
                names=["label", "found"],
            )

    return tidy(run)


def dual_coordinate_descent(
    rows: list[np.ndarray],
    signs: np.ndarray,
    scale: np.ndarray,
    settings: Settings,
    shares: np.ndarray | None = None,
) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised squared-hinge SVM, one dual variable at a time.

    A row is the set of its columns; column j has the value ``scale[j]``, the bias column 1. The loss
    of row i counts ``shares[i]`` times, once by default.
    """
    weights, bias = np.zeros(len(scale)), 0.0
    diagonal = 1.0 / (2.0 * settings.penalty * (np.ones(len(rows)) if shares is None else shares))
    norms = np.array([float(np.square(scale[r]).sum()) + 1.0 + d for r, d in zip(rows, diagonal)])
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(17)
    for _ in range(settings.epochs):
        for i in order.permutation(len(rows)):
            columns = rows[i]
            values = scale[columns]
            gradient = signs[i] * (float(weights[columns] @ values) + bias) - 1.0 + diagonal[i] * alpha[i]
            updated = max(alpha[i] - gradient / norms[i], 0.0)
            step = (updated - alpha[i]) * signs[i]
            if step:
                weights[columns] += step * values
                bias += step
                alpha[i] = updated
    return weights, bias


def _squash(margins: np.ndarray, labels: np.ndarray, shares: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve from margin to the odds of label 1 (Newton's method)."""
    ones, zeros = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    slope, shift = 1.0, 0.0
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
        d, w = shares * (p - target), shares * np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ margins, d.sum()])
        h = np.array([[w @ np.square(margins) + 1e-6, w @ margins], [w @ margins, w.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        size = np.abs(move).max()
        slope, shift = slope - move[0] * min(1, 2 / size if size else 1), shift - move[1] * min(1, 2 / size if size else 1)
        if size < 1e-7:
            break
    return max(slope, 1e-3), shift


def log_count_ratios(ones: np.ndarray, zeros: np.ndarray, smoothing: float) -> np.ndarray:
    p, q = ones + smoothing, zeros + smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit(
    docs: DataFrame, labels: DataFrame, label: str, extract: Extractor, settings: Settings
) -> Model:
    """Fit on a bounded sample of the rows whose labels may be used.

    Without any labelled row, or with one class only, all scores are that class's share of the
    sample (0.5 without rows).
    """
    scratch = Scratch(docs.sparkSession, f"fit-{label}")
    sample = scratch.store(_sample(docs, labels, label, settings), "sample")
    by_class = dict(sample.groupBy("label").count().collect())
    if len(by_class) < 2:
        share = {0: -20.0, 1: 20.0}.get(next(iter(by_class), None), 0.0)
        scratch.drop("sample")
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, 0.0, share)
    n_ones, n_zeros = by_class[1], by_class[0]
    totals = _class_totals(docs, labels, label, settings, by_class)
    # What a sampled row stands for, 1 on average: the penalty stays that of the rows at hand.
    each = np.array([totals[0] / n_zeros, totals[1] / n_ones])
    each *= (n_ones + n_zeros) / (totals[0] + totals[1])
    counts = (
        sample.select("label", "text")
        .mapInArrow(_counting(extract), "feature int, ones int, zeros int")
        .groupBy("feature")
        .agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
        .where(F.col("ones") + F.col("zeros") >= settings.min_texts)
    )
    apart = F.abs(F.col("ones") / n_ones - F.col("zeros") / n_zeros)
    share = (F.col("ones") * float(each[1]) + F.col("zeros") * float(each[0])) / (n_ones + n_zeros)
    spread = F.sqrt(share)
    best = counts.orderBy((apart / spread).desc(), "feature").limit(settings.max_features)
    chosen = best.toPandas().sort_values("feature")
    features = chosen["feature"].to_numpy(np.int64)
    ratios = log_count_ratios(
        chosen["ones"].to_numpy(float), chosen["zeros"].to_numpy(float), settings.smoothing
    )
    table = sample.select("label", "text").mapInArrow(
        _restricted(extract, features), "label int, found array<int>"
    ).toArrow()
    scratch.drop("sample")
    found = table["found"].combine_chunks()
    ends = found.offsets.to_numpy()
    flat = found.values.to_numpy(zero_copy_only=False)
    rows = [flat[ends[i] : ends[i + 1]] for i in range(len(found))]
    truth = table["label"].to_numpy()
    # The collected rows come in no fixed order; the fit must not depend on it.
    order = sorted(range(len(rows)), key=lambda i: (truth[i], len(rows[i]), rows[i].tobytes()))
    rows, truth = [rows[i] for i in order], truth[order]
    signs = np.where(truth == 1, 1.0, -1.0)
    shares = each[truth]
    fold = np.arange(len(rows)) % 3

    margins = np.zeros(len(rows))
    for k in range(3):
        inside = np.flatnonzero(fold != k)
        w, b = dual_coordinate_descent([rows[i] for i in inside], signs[inside], ratios, settings, shares[inside])
        w = _interpolate(w, settings) * ratios
        for i in np.flatnonzero(fold == k):
            margins[i] = w[rows[i]].sum() + b
    slope, shift = _squash(margins, truth, shares)
    w, b = dual_coordinate_descent(rows, signs, ratios, settings, shares)
    return Model(features, _interpolate(w, settings) * ratios, b, slope, shift)


def _interpolate(weights: np.ndarray, settings: Settings) -> np.ndarray:
    """Between naive Bayes (one weight for all) and the SVM."""
    mean = float(np.abs(weights).mean()) if len(weights) else 0.0
    return (1 - settings.interpolation) * mean + settings.interpolation * weights


def score(docs: DataFrame, model: Model, extract: Extractor) -> DataFrame:
    """All rows and columns of ``docs`` with a ``score``; a null text scores as an empty one."""
    columns = docs.columns
    place = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(1 << HASH_BITS, bool)
        keep[model.features] = True
        weights = np.zeros(1 << HASH_BITS)
        weights[model.features] = model.weights
        for batch in batches:
            for part in bounded(batch):
                margins = np.fromiter(
                    (weights[x].sum() for x in text_features(part.column(place), extract, keep)),
                    float,
                    part.num_rows,
                )
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(model.scores(margins + model.bias))],
                    names=[*columns, "score"],
                )

    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.mapInArrow(tidy(run), schema)
