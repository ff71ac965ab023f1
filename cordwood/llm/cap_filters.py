"""Near-duplicate embeddings by spherical-cap filters.

Filters are directions of a random product code: a rotated vector is cut into blocks, every block
has a random code of its own, and a direction is one code word per block. A vector passes a filter
if its inner product with the direction reaches a cap. List decoding finds these directions block
by block, without a look at all of them. Vectors that pass one filter in common, in any of a few
independent codes, are candidates; their cosine is then computed exactly. The cap follows from the
length of the vectors, the number of codes from the odds to miss a pair at the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordwood.llm.common import Scratch, maybe_broadcast
from cordwood.llm.components import components

COSINE = 0.93
# Vectors of fewer than eight components have one block. ``CAP`` is the cap of 64 dimensions.
BLOCKS, WORDS, CAP = 2, 128, 0.40
# Filters that a vector passes in one code on average, and the odds to miss a pair at the threshold
# in all codes. Random vectors of eight and more components share 0.004 filters in each code.
FILTERS, MISSED = 8.0, 0.002
# Codes after which wider caps are tried, and the pairs that measure the odds.
MAX_CODES, TRIALS = 48, 2000
# Bytes of all distinct vectors up to which they are broadcast to the candidate pairs.
BROADCAST_BYTES, COMPONENT_BYTES = 16 << 20, 4


def _code(dimension: int, code: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rotation and the code words of each block, the same on every machine."""
    draw = np.random.default_rng([dimension, code])
    rotation, _ = np.linalg.qr(draw.normal(size=(dimension, dimension)))
    words = []
    for size in map(len, np.array_split(np.arange(dimension), BLOCKS if dimension >= 8 else 1)):
        block = draw.normal(size=(WORDS, size))
        words.append(block / np.linalg.norm(block, axis=1, keepdims=True))
    return rotation, words


def decode(
    vectors: np.ndarray,
    code: int,
    cap: float = CAP,
    made: tuple[np.ndarray, list[np.ndarray]] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for every filter that a unit vector passes; ``made`` is the code if at hand."""
    dimension = vectors.shape[1]
    rotation, words = made or _code(dimension, code)
    turned = vectors @ rotation
    cuts = np.array_split(np.arange(dimension), len(words))
    products = [turned[:, cut] @ block.T / np.sqrt(len(words)) for cut, block in zip(cuts, words)]
    # What the blocks after this one can still add at most.
    rest = np.cumsum([0.0 * products[0][:, 0], *(p.max(axis=1) for p in products[:0:-1])], axis=0)[::-1]
    rows = np.arange(len(vectors))
    number, reached = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    for product, later in zip(products, rest):
        sums = reached[:, None] + product[rows]
        at, word = np.nonzero(sums + later[rows][:, None] >= cap)
        rows, number, reached = rows[at], number[at] * WORDS + word, sums[at, word]
    return rows, number


def cap_of(dimension: int, share: float) -> float:
    """The cap that a random unit vector reaches along a direction with odds of ``share``."""
    if dimension == 1:
        return 0.0
    angles = np.linspace(0.0, np.pi, 100_001)[1:-1]
    density = np.exp((dimension - 2) * np.log(np.sin(angles)))
    return float(np.cos(np.interp(share, np.cumsum(density) / density.sum(), angles)))


def plan(dimension: int, threshold: float) -> tuple[float, int]:
    """Cap and number of codes that miss a pair of cosine ``threshold`` with odds of ``MISSED``.

    The odds are measured on random pairs: after a random rotation all pairs of one cosine have the
    same. No codes means that no filter tells such pairs apart from others.
    """
    draw = np.random.default_rng([dimension, TRIALS])
    cosine = float(np.clip(threshold, -1.0, 1.0))
    one, other = draw.normal(size=(2, TRIALS, dimension))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= np.einsum("ij,ij->i", one, other)[:, None] * one
    other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-12)
    other = cosine * one + np.sqrt(1.0 - cosine * cosine) * other
    directions = WORDS ** (BLOCKS if dimension >= 8 else 1)
    filters = FILTERS
    while cosine > 0 and filters <= directions / 16:
        cap = cap_of(dimension, filters / directions)
        missed = 0.0
        for code in range(2):
            (row_a, number_a), (row_b, number_b) = decode(one, code, cap), decode(other, code, cap)
            common = np.intersect1d(row_a * directions + number_a, row_b * directions + number_b)
            missed += (1.0 - len(np.unique(common // directions)) / TRIALS) / 2
        codes = int(np.ceil(np.log(MISSED) / np.log(np.clip(missed, 1e-9, 1 - 1e-9))))
        if codes <= MAX_CODES:
            return cap, codes
        filters *= 2
    return -1.0, 0


def _filters(plans: dict[int, tuple[float, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def passed(nodes: np.ndarray, number: np.ndarray, size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes), pa.array(number * 4096 + min(size, 4095))], names=["node", "filter"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for size in map(int, np.unique(sizes)):
                if size not in plans:
                    continue
                cap, codes = plans[size]
                own = np.flatnonzero(sizes == size)
                if not codes:
                    yield passed(nodes[own], np.zeros(len(own), np.int64), size)
                for code in range(codes):
                    made = _code(size, code)
                    for at in range(0, len(own), 512):
                        some = own[at : at + 512]
                        flat = batch.column(1).take(pa.array(some)).flatten()
                        block = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
                        block /= np.linalg.norm(block, axis=1, keepdims=True)
                        rows, number = decode(block, code, cap, made)
                        yield passed(nodes[some[rows]], number * codes + code, size)

    return run


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            sizes = np.diff(left.offsets.to_numpy())
            sizes[sizes != np.diff(right.offsets.to_numpy())] = 0
            cosine = np.full(batch.num_rows, -1.0)
            for size in map(int, np.unique(sizes[sizes > 0])):
                rows = np.flatnonzero(sizes == size)
                a, b = (
                    x.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
                    for x in (left, right)
                )
                norms = np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
                cosine[rows] = np.einsum("ij,ij->i", a, b) / norms
            close = np.flatnonzero(cosine >= threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(close)), batch.column(1).take(pa.array(close))], names=["u", "v"]
            )

    return run


def near_duplicates(vectors: DataFrame, threshold: float = COSINE) -> DataFrame:
    """Link vectors of one label whose cosine is at least ``threshold``.

    Returns a row per row of ``vectors``: vec_id, n_links (other rows linked directly),
    component_id (smallest vec_id reachable, itself included), kept. Only vec_id, embedding and
    label are read. Rows with a null label or vector, an empty or zero vector, or a null, infinite
    or NaN component link with nothing. Vectors of different length never link. Rows are told
    apart by label and vector, so repeated ids and missing ids are allowed; a missing id names no
    component and is not kept. Equal vectors are one class and link with each other.
    An empty table gives no rows.
    """
    scratch = Scratch(vectors.sparkSession, "caps")
    rows = vectors.select("vec_id", "embedding", "label")
    sound = F.coalesce(
        F.col("label").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    keyed = rows.select(
        "vec_id", "embedding", "label", F.when(sound, F.xxhash64("label", "embedding")).alias("node")
    )
    classes = scratch.store(
        keyed.where("node is not null")
        .groupBy("node", "label", "embedding")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("vec_id")),
        "classes",
    )
    # A length that only one vector has links with nothing. A row per length, with its plan.
    lengths = classes.groupBy(F.size("embedding").alias("size")).count().where("count > 1").collect()
    plans = {r["size"]: plan(r["size"], threshold) for r in lengths}
    passed = (
        classes.select("node", "embedding")
        .mapInArrow(_filters(plans), "node long, filter long")
        .join(classes.select("node", "label"), "node")
    )
    passed = scratch.store(passed, "filters")
    left = passed.select(F.col("node").alias("u"), "label", "filter")
    right = passed.select(F.col("node").alias("v"), "label", "filter")
    pairs = scratch.store(
        left.join(right, ["label", "filter"]).where("u < v").select("u", "v").distinct(), "pairs"
    )
    known = classes.select("node", "embedding")
    components_in_all = classes.agg(F.sum(F.size("embedding"))).first()[0] or 0
    few = components_in_all * COMPONENT_BYTES <= BROADCAST_BYTES
    of_u = known.select(F.col("node").alias("u"), F.col("embedding").alias("of_u"))
    of_v = known.select(F.col("node").alias("v"), F.col("embedding").alias("of_v"))
    with_both = (
        pairs.join(F.broadcast(of_u) if few else of_u, "u")
        .join(F.broadcast(of_v) if few else of_v, "v")
        .select("u", "v", "of_u", "of_v")
    )
    links = scratch.store(with_both.mapInArrow(_verified(threshold), "u long, v long"), "links")
    scratch.drop("filters", "pairs")

    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = (
        both.join(classes.select(F.col("node").alias("v"), "copies"), "v")
        .groupBy(F.col("u").alias("node"))
        .agg(F.sum("copies").alias("around"))
    )
    named = components(links, scratch, "near")
    smallest = (
        named.join(classes.select("node", "vec_id"), "node")
        .groupBy("root")
        .agg(F.min("vec_id").alias("component_id"))
    )
    of_class = (
        classes.select("node", "copies", "vec_id")
        .join(linked, "node", "left")
        .join(named.join(smallest, "root").select("node", "component_id"), "node", "left")
        .select(
            "node",
            (F.col("copies") - 1 + F.coalesce("around", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
    )
    return (
        keyed.select("vec_id", "node")
        .join(maybe_broadcast(of_class, classes.count()), "node", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
