"""How far the sources of a language differ in their terms, by ranking cells of equal counts.

Terms with the same counts have the same divergence. So terms are grouped into cells by (count in
the group, count in the language), or for two sources by their two counts; divergences are worked
out per cell, cells of equal value are merged and ranked by cumulative multiplicity, and only the
cells that reach the ranks asked for are expanded into terms.

Counting is one pass over the texts with bounded tables in each task; everything after it is
Spark's grouping and joining of counted terms. All numbers are whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cordwood.llm.common import Scratch
from cordwood.llm.shingles import text_bytes

SCALE = 1_000_000_000
MIN_DOCUMENTS = 3
RANKS = 200
# Terms a task counts before it hands them on, and bytes of a text split at once.
TABLE_TERMS, PIECE_BYTES = 400_000, 1 << 20

# Letters A to Z in lower case, all other ASCII characters as separators.
_TERM_BYTES = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if 97 <= byte <= 122 or byte >= 128 else 32 for byte in range(256)
)


def _term_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded piece at a time, cut between terms."""
    if len(text) <= PIECE_BYTES:
        yield text.translate(_TERM_BYTES).split()
        return
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        piece = text[at:end].translate(_TERM_BYTES)
        while end < len(text) and b" " not in piece:  # one term longer than a piece
            piece += text[end : end + PIECE_BYTES].translate(_TERM_BYTES)
            end += PIECE_BYTES
        if end < len(text):
            piece = piece[: piece.rindex(b" ") + 1]
        yield piece.split()
        at += len(piece)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, documents) in tables.items():
            size = len(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * size, pa.string()),
                    pa.array([source] * size, pa.string()),
                    pa.array(list(counts), pa.binary()).cast(pa.string()),
                    pa.array(list(counts.values()), pa.int64()),
                    pa.array([documents[term] for term in counts], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "documents"],
            )
        tables.clear()

    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        whole = data.tobytes()
        for row, (lang, source) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            counts, documents = tables.setdefault((lang, source), (Counter(), Counter()))
            before = len(counts)
            found: set[bytes] = set()
            for terms in _term_pieces(whole[offsets[row] : offsets[row + 1]]):
                counts.update(terms)
                found.update(terms)
            documents.update(found)
            held += len(counts) - before
            if held >= TABLE_TERMS:
                yield from flush()
                held = 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, documents)``: occurrences of each term and the documents it is in.

    Null texts, languages and sources read as ''. Terms are runs of ASCII letters, A to Z in lower
    case, and of all characters beyond ASCII. Rows are dealt out by language and term: what tasks
    counted already hardly merges before the shuffle, and totals per term need no other one.
    """
    said = docs.select(*(F.coalesce(F.col(name), F.lit("")).alias(name) for name in ("lang", "source", "text")))
    partial = said.mapInArrow(_count, "lang string, source string, term string, n long, documents long")
    dealt = partial.repartition("lang", "term")
    return dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), in whole numbers of any size."""
    over = (F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")).cast("decimal(29,0)")
    return _div(over, (total + kept).cast("decimal(19,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so a long holds the square."""
    return _div((p - q) * (p - q), q)


def _div(over: Column, under: Column) -> Column:
    """Division of whole numbers that are not negative, rounded down."""
    return F.call_function("div", over, under)


def _sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, source, n_group, n_lang, n_terms)`` of every group that occurs, with terms or not."""
    groups = docs.select(*(F.coalesce(F.col(name), F.lit("")).alias(name) for name in ("lang", "source"))).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    terms = kept.groupBy("lang", "term").agg(F.max("total").alias("total"))
    langs = terms.groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count("*").alias("n_terms"))
    return groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n_group", "n_lang", "n_terms"])


def kept_terms(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``(lang, source, term, n, total)`` of terms in enough documents of their language.

    ``n`` counts occurrences in the group, ``total`` in the language. The window holds a row per
    source that has the term, counted before, so a frequent one makes no large group.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    of_lang = Window.partitionBy("lang", "term")
    totals = (F.sum("n").over(of_lang).alias("total"), F.sum("documents").over(of_lang).alias("in_documents"))
    counts = term_counts(docs).select("lang", "source", "term", "n", *totals)
    return scratch.store(counts.where(F.col("in_documents") >= min_documents).drop("in_documents"), "kept")


def leading_terms(kept: DataFrame, sizes: DataFrame, ranks: int = RANKS) -> DataFrame:
    """``(lang, source, item, value, rank)``: the terms of each group that stand out of its language.

    Only terms with a larger share in the group than in the language count; equal values follow in
    UTF-8 order. Results end at rank ``ranks``.
    """
    group = ["lang", "source"]
    p = share(F.col("n"), F.col("n_group"), F.col("n_terms"))
    q = share(F.col("total"), F.col("n_lang"), F.col("n_terms"))
    cells = (
        kept.groupBy(*group, "n", "total")
        .agg(F.count("*").alias("terms"))
        .join(sizes, group)
        .select(*group, "n", "total", "terms", p.alias("p"), q.alias("q"))
        .where("p > q")
        .select(*group, "n", "total", "terms", distance(F.col("p"), F.col("q")).alias("value"))
    )
    # Every value has a term at least, so no more than ``ranks`` values are needed.
    falling = Window.partitionBy(*group).orderBy(F.desc("value"))
    merged = (
        cells.groupBy(*group, "value")
        .agg(F.sum("terms").alias("terms"))
        .withColumn("place", F.row_number().over(falling))
        .where(F.col("place") <= ranks)
    )
    upto = F.sum("terms").over(falling.rowsBetween(Window.unboundedPreceding, 0))
    reached = merged.select(*group, "value", (upto - F.col("terms")).alias("before")).where(F.col("before") < ranks)
    chosen = cells.join(reached, [*group, "value"]).select(*group, "n", "total", "value", "before")
    within = Window.partitionBy(*group, "value").orderBy("term")
    return (
        kept.join(chosen, [*group, "n", "total"])
        .select(*group, F.col("term").alias("item"), "value", "before", F.row_number().over(within).alias("place"))
        .where(F.col("place") <= ranks)
        .select(*group, "item", "value", (F.col("before") + F.col("place")).cast("int").alias("rank"))
        .where(F.col("rank") <= ranks)
    )


def source_distances(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(lang, source, item, value, rank)``: the distance of each source from each other one.

    The value sums over all kept terms of the language. Cells of two counts that are both there are
    counted from common terms; the others follow from what each source has in all.
    """
    one = sizes.select("lang", F.col("source").alias("a"), F.col("n_group").alias("n_a"), "n_terms")
    other = sizes.select("lang", F.col("source").alias("b"), F.col("n_group").alias("n_b"))
    pairs = one.join(other, "lang").where("a != b")
    here = kept.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("x"))
    there = kept.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("y"))
    half = here.join(there, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "x", "y").agg(F.count("*").alias("terms"))
    turned = half.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("y").alias("x"), F.col("x").alias("y"), "terms")
    both = half.unionByName(turned)
    own = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))

    def f(x: Column, y: Column) -> Column:
        return distance(share(x, F.col("n_a"), F.col("n_terms")), share(y, F.col("n_b"), F.col("n_terms")))

    none, x, y, terms = F.lit(0), F.col("x"), F.col("y"), F.col("terms")
    # With terms of neither source as the base, each cell adds what it differs from that.
    of_both = both.join(pairs, ["lang", "a", "b"]).select(
        "lang", "a", "b", (terms * (f(x, y) - f(x, none) - f(none, y) + f(none, none))).alias("value")
    )
    of_one = own.select("lang", F.col("source").alias("a"), F.col("n").alias("x"), "terms").join(pairs, ["lang", "a"]).select(
        "lang", "a", "b", (terms * (f(x, none) - f(none, none))).alias("value")
    )
    of_other = own.select("lang", F.col("source").alias("b"), F.col("n").alias("y"), "terms").join(pairs, ["lang", "b"]).select(
        "lang", "a", "b", (terms * (f(none, y) - f(none, none))).alias("value")
    )
    of_none = pairs.select(
        "lang", "a", "b",
        F.when(F.col("n_terms") > 0, F.col("n_terms") * f(none, none)).otherwise(0).alias("value"),
    )
    summed = (
        of_both.unionByName(of_one).unionByName(of_other).unionByName(of_none)
        .select("lang", "a", "b", F.col("value").cast("decimal(38,0)").alias("value"))
        .groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value"))
    )
    order = Window.partitionBy("lang", "a").orderBy(F.desc("value"), "b")
    return summed.select(
        "lang", F.col("a").alias("source"), F.col("b").alias("item"), "value", F.row_number().over(order).alias("rank")
    )


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: parts ``pair`` and ``term`` for every group.

    Reads lang, source and text alone, so other columns may have any name. Null values read as '';
    a repeated row counts again; texts of any length are read whole. A language without kept terms
    has distances of 0, a group without terms has distances and no ``term`` rows; an empty table
    gives no rows.
    """
    kept = kept_terms(docs, min_documents)
    sizes = Scratch(docs.sparkSession, "divergence").store(_sizes(docs, kept), "sizes")
    parts = (("pair", source_distances(kept, sizes)), ("term", leading_terms(kept, sizes, ranks)))
    pair, term = (
        found.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, found in parts
    )
    return pair.unionByName(term)
