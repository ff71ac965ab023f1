"""Benchmark decontamination on DataFrame functions alone.

A passage of a document matches a benchmark item if some window of the item's size has a weighted
word-shingle similarity of ``threshold`` percent with it. Steps:

1. Positions of a document whose shingle occurs in an item. A window that matches can be moved to
   begin at such a position (or to the end of the text) without losing similarity, and must hold
   enough of them; each such window is a candidate, so none that matches is missed here.
2. The SimHash of each window against that of the item, by a multi-index of eight-bit blocks: two
   fingerprints at most ``RADIUS`` bits apart have a block at most ``RADIUS // BLOCKS`` bits apart,
   and the items are indexed under all such values.
3. The exact weighted similarity of what is left.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordwood.llm.common import Scratch, maybe_broadcast

WORDS = 5
THRESHOLD = 80  # percent
BLOCKS, BLOCK_BITS = 8, 8
# A window of similarity 0.8 is 10 bits from its item on average, with a deviation of 3.
RADIUS = 23

_SEPARATORS = r"[^\p{L}\p{M}\p{N}]+"
_LANES = 0x0000000100000001


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def _grams(words: str, width: int) -> Column:
    """Hashes of all runs of ``width`` words, repeats included; none for fewer words."""
    words = F.col(words)

    def gram(at: Column) -> Column:
        return F.xxhash64(F.lit(width), *(F.get(words, at + k) for k in range(width)))

    return F.when(
        F.size(words) >= width, F.transform(F.sequence(F.lit(0), F.size(words) - width), gram)
    ).otherwise(F.array().cast("array<bigint>"))


def _needed(weight: Column, other: Column, threshold: int) -> Column:
    """The least overlap of two sets of shingles with these weights."""
    return F.ceil((weight + other) * threshold / (100 + threshold) - 1e-9)


def _simhash(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """A 64-bit fingerprint per key of rows ``(keys, gram, n)``: the sign of each weighted bit."""
    lanes = [
        F.sum(F.shiftrightunsigned("gram", bit).bitwiseAND(F.lit(_LANES)) * F.col("n")).alias(f"lane{bit}")
        for bit in range(32)
    ]
    summed = weighted.groupBy(*keys).agg(F.sum("n").alias("weight"), *lanes)
    bits = []
    for bit in range(64):
        lane = F.col(f"lane{bit % 32}")
        count = F.shiftrightunsigned(lane, 32) if bit >= 32 else lane.bitwiseAND(F.lit(0xFFFFFFFF))
        bits.append(F.when(count * 2 > F.col("weight"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
    return summed.select(*keys, "weight", reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fingerprint"))


def _blocks(fingerprint: Column, masks: list[int]) -> Column:
    """(block, value) pairs of a fingerprint, each value changed by every mask."""
    changes = F.array(*(F.lit(mask).cast("long") for mask in masks))

    def of_block(block: int) -> Column:
        value = F.shiftrightunsigned(fingerprint, block * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
        return F.transform(
            changes,
            lambda mask: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(mask).alias("value")),
        )

    return F.flatten(F.array(*(of_block(block) for block in range(BLOCKS))))


def _near_masks() -> list[int]:
    """Every change of a block that two fingerprints within the radius need at most."""
    most = RADIUS // BLOCKS
    return [
        sum(1 << bit for bit in bits)
        for size in range(most + 1)
        for bits in combinations(range(BLOCK_BITS), size)
    ]


def _matches(texts: DataFrame, items: DataFrame, width: int, threshold: int, scratch: Scratch) -> DataFrame:
    """Matches of the items that have shingles of ``width`` words: the best window of each text.

    ``texts`` is (doc_id, text, text_key), ``items`` is (item_key, words).
    """
    listed = items.select("item_key", F.explode_outer(_grams("words", width)).alias("gram")).where("gram is not null")
    item_grams = scratch.store(
        listed.groupBy("item_key", "gram").agg(F.count(F.lit(1)).alias("n_item")), f"item-grams-{width}"
    )
    n_grams = item_grams.count()
    prints = _simhash(item_grams.withColumnRenamed("n_item", "n"), ["item_key"]).select(
        "item_key", F.col("weight").alias("item_weight"), F.col("fingerprint").alias("item_print")
    )
    prints = scratch.store(prints, f"item-prints-{width}")
    n_items = prints.count()

    worded = texts.select("doc_id", "text_key", _words(F.col("text")).alias("words"))
    # The size is taken before the explode: a column taken from the array after it would carry the
    # whole array along with each of its elements. An outer explode, because for an inner one
    # Spark filters by the size of the array below the step that splits the text into words, and
    # so splits it again for every word.
    sized = worded.select("doc_id", "text_key", _grams("words", width).alias("grams")).select(
        "doc_id", "text_key", "grams", F.size("grams").alias("size")
    )
    placed = sized.select("doc_id", "text_key", "size", F.posexplode_outer("grams").alias("at", "gram"))
    hits = scratch.store(
        placed.join(maybe_broadcast(item_grams.select("gram", "item_key"), n_grams), "gram").select(
            "doc_id", "text_key", "size", "at", "item_key"
        ),
        f"hits-{width}",
    )

    sized = hits.select("text_key", "size", "at", "item_key").distinct().join(
        maybe_broadcast(prints.select("item_key", "item_weight"), n_items), "item_key"
    )
    span = F.least("size", "item_weight").cast("int")
    numbered = sized.withColumn("span", span).withColumn(
        "start", F.least(F.col("at"), F.col("size") - F.col("span"))
    ).selectExpr(
        "*", "row_number() OVER (PARTITION BY text_key, item_key ORDER BY at) AS place"
    )
    need = _needed(F.col("item_weight"), F.col("span"), threshold)
    begun = numbered.select(
        "text_key", "item_key", "start", "span", (F.col("place") + need - 1).cast("int").alias("place")
    )
    reached = numbered.select("text_key", "item_key", "place", F.col("at").alias("last"))
    windows = scratch.store(
        begun.join(reached, ["text_key", "item_key", "place"])
        .where(F.col("last") < F.col("start") + F.col("span"))
        .select("text_key", "item_key", "start", "span")
        .distinct(),
        f"windows-{width}",
    )
    wanted = scratch.store(windows.select("text_key").distinct(), f"wanted-{width}")
    held = (
        texts.select("text_key", "text")
        .join(maybe_broadcast(wanted, wanted.count()), "text_key", "left_semi")
        .dropDuplicates(["text_key"])
        .select("text_key", _words(F.col("text")).alias("words"))
        .select("text_key", _grams("words", width).alias("grams"))
    )
    window = ["text_key", "item_key", "start"]
    weighted = scratch.store(
        windows.join(held, "text_key")
        .select(*window, F.explode_outer(F.slice("grams", F.col("start") + 1, F.col("span"))).alias("gram"))
        .groupBy(*window, "gram")
        .agg(F.count(F.lit(1)).alias("n")),
        f"weighted-{width}",
    )

    looked_up = prints.select("item_key", "item_weight", "item_print", F.explode(_blocks(F.col("item_print"), _near_masks())).alias("b")).select(
        "item_key", "item_weight", "item_print", "b.block", "b.value"
    )
    near = (
        _simhash(weighted, window)
        .select(*window, "weight", "fingerprint", F.explode(_blocks(F.col("fingerprint"), [0])).alias("b"))
        .select(*window, "weight", "fingerprint", "b.block", "b.value")
        .join(looked_up, ["item_key", "block", "value"])
        .where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        .select(*window, "weight", "item_weight")
        .distinct()
    )
    overlap = (
        near.join(weighted, window)
        .join(maybe_broadcast(item_grams, n_grams), ["item_key", "gram"])
        .groupBy(*window, "weight", "item_weight")
        .agg(F.sum(F.least("n", "n_item")).alias("overlap"))
    )
    union = F.col("weight") + F.col("item_weight") - F.col("overlap")
    best = (
        overlap.where(F.col("overlap") * 100 >= union * threshold)
        .select("text_key", "item_key", F.struct(
            (F.col("overlap") / union).alias("similarity"), (-F.col("start")).alias("back")
        ).alias("found"))
        .groupBy("text_key", "item_key")
        .agg(F.max("found").alias("found"))
    )
    rows = hits.select("doc_id", "text_key").distinct()
    return best.join(rows, "text_key").select(
        "doc_id", "text_key", "item_key", "found.similarity", (-F.col("found.back")).alias("start_word")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs of a document and a benchmark item that one of its passages repeats.

    Words are lower-cased runs of letters, marks and digits; shingles are of five words, for an
    item of fewer words all of them. Returns one row per pair: doc_id, item_id, similarity of the
    best window, start_word (the first such window), text_key (hash of the text). Only doc_id,
    text and item_id, text are read. Null and empty texts match nothing on either side. A repeated
    row changes nothing; texts without an id give rows with a null id, told apart by text_key.
    An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    named = benchmark.select("item_id", F.xxhash64("text").alias("item_key"), _words(F.col("text")).alias("words"))
    items = scratch.store(named.where(F.size("words") > 0), "items")
    once = items.dropDuplicates(["item_key"])
    widths = sorted(row[0] for row in items.select(F.least(F.size("words"), F.lit(WORDS))).distinct().collect())
    found = None
    for width in widths or [WORDS]:
        fitting = once.where(
            F.size("words") >= WORDS if width == WORDS else F.size("words") == width
        ).select("item_key", "words")
        part = _matches(texts, fitting, width, threshold, scratch)
        found = part if found is None else found.unionByName(part)
    return (
        found.join(items.select("item_id", "item_key").distinct(), "item_key")
        .select("doc_id", "item_id", "similarity", "start_word", "text_key")
        .distinct()
    )
