"""N-gram Jaccard self-join by vertical partitioning.

Equal sets are one class from the start. A class can only link if nearly all its n-grams occur in
some other class too, which a fixed range of the hashes (the first fragment) shows for most
classes; the others leave. For the rest the n-grams get a global order, rarest first. Two linked
sets share one of their first few n-grams in that order (prefix), so postings of prefixes give the
pairs to verify. The order is cut into fragments, the overlap of a pair is counted in each fragment
by itself, and the counts are summed per pair.

No group is expanded into all its pairs: the sets of a posting are first compared with the most
central one only; what is connected after that needs no further pair, and only sets of different
components that could still link by their sizes are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordwood.llm.common import bounded, maybe_broadcast, put_back, Scratch, set_apart, tidy
from cordwood.llm.components import components
from cordwood.llm.shingles import set_fingerprint, shingle_sets

WORDS = 4
THRESHOLD = 85  # percent
FRAGMENTS = 12

# The hash range of the first fragment, as a share of all hashes. It decides how many classes
# leave early, never which pairs link.
FIRST_SHARE = 0.25
_KEY_BITS = 40


def _as_signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _describe(words: int, share: float):
    """Per row: set size, its n-grams in the first fragment, and the fingerprint of the set."""
    limit = np.uint64(int(share * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, nodes = [], [], []
            for hashes in shingle_sets(batch.column(1), words):
                sizes.append(len(hashes))
                first.append(int(np.searchsorted(hashes, limit)))
                nodes.append(set_fingerprint(hashes) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(sizes, pa.int64()),
                    pa.array(first, pa.int64()),
                    pa.array(nodes, pa.int64()),
                ],
                names=["doc_id", "text_key", "n_shingles", "n_first", "node"],
            )

    return tidy(run)


def _rows(keys: np.ndarray, nodes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.array(nodes), pa.array(counts)], names=["key", "node", "seen"]
    )


def _sightings(words: int, share: float):
    """N-grams of the first fragment by class.

    An n-gram that two classes of one batch hold is known to be shared: the classes get it counted
    at once (a row with a negative key), and only two of its sightings go on as evidence for other
    batches. So a very common n-gram sends two rows per batch, however many sets hold it.
    """
    limit = np.uint64(int(share * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[int, np.ndarray] = {}
            for hashes in shingle_sets(batch.column(0), words):
                if len(hashes):
                    node = set_fingerprint(hashes)
                    if node not in parts:
                        parts[node] = hashes[: np.searchsorted(hashes, limit)].copy()
            if not parts:
                continue
            keys = np.concatenate(list(parts.values())) >> np.uint64(64 - _KEY_BITS)
            nodes = np.repeat(
                np.fromiter(parts, np.int64, len(parts)), [len(x) for x in parts.values()]
            )
            order = np.argsort(keys, kind="stable")
            keys, nodes = keys[order].astype(np.int64), nodes[order]
            fresh = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
            at = np.flatnonzero(fresh)
            lengths = np.diff(at, append=len(keys))
            single = np.repeat(lengths == 1, lengths)
            yield _rows(keys[single], nodes[single], np.ones(int(single.sum()), np.int32))
            common = at[lengths > 1]
            for place in (common, common + 1):
                yield _rows(keys[place], nodes[place], np.zeros(len(place), np.int32))
            known, counts = np.unique(nodes[~single], return_counts=True)
            yield _rows(-1 - (known & ((1 << 48) - 1)), known, counts.astype(np.int32))

    return tidy(run)


def _shared_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: how many keys of a class were seen with another class as well.

    A key has at most two rows per batch of the step before, so the run that a batch boundary cuts
    is held back whole.
    """
    held: list[np.ndarray] = []

    def counted(keys, nodes, seen):
        known = keys < 0
        fresh = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
        at = np.flatnonzero(fresh)
        lengths = np.diff(at, append=len(keys))
        low, high = np.minimum.reduceat(nodes, at), np.maximum.reduceat(nodes, at)
        shared = np.repeat(low != high, lengths)
        take = (shared & (seen > 0)) | known
        ids, back = np.unique(nodes[take], return_inverse=True)
        sums = np.bincount(back, weights=seen[take], minlength=len(ids)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums)], names=["node", "n_seen"])

    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        if held:
            columns = [np.concatenate(pair) for pair in zip(held, columns)]
        if not len(columns[0]):
            continue
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        held = [column[cut:] for column in columns]
        if cut:
            yield counted(*(column[:cut] for column in columns))
    if held and len(held[0]):
        yield counted(*held)


def _whole_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in bounded(batch)):
            nodes, sets = [], []
            for hashes in shingle_sets(part.column(0), words):
                if len(hashes):
                    nodes.append(set_fingerprint(hashes))
                    sets.append(_as_signed(hashes))
            lengths = np.cumsum([0, *map(len, sets)])
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(values)),
                ],
                names=["node", "grams"],
            )

    return tidy(run)


def _may_differ(size: Column, threshold: int) -> Column:
    """How many n-grams a set can have that a linked set lacks."""
    return F.floor((size * (100 - threshold)) / 100).cast("long")


def _needed(left: Column, right: Column, threshold: int) -> Column:
    """The least overlap of two linked sets of these sizes."""
    total = (left + right) * threshold
    return F.floor((total + (99 + threshold)) / (100 + threshold)).cast("long")


def _could_link(a: str, b: str, threshold: int) -> Column:
    """Whether two sets that share this n-gram can link, by size, shared n-grams and position."""
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    need = _needed(size_a, size_b, threshold)
    rest = F.least(size_a - F.col(f"{a}.position"), size_b - F.col(f"{b}.position"))
    return (F.least(F.col(f"{a}.shared"), F.col(f"{b}.shared")) >= need) & (rest >= need)


def _order_key() -> Column:
    """The global order as one number: classes that hold the n-gram, then its hash."""
    return F.col("held_by") + F.shiftrightunsigned("gram", 12).cast("double") / float(1 << 52)


class _Fragments:
    """The sets cut along the global order; overlaps are counted cut by cut."""

    def __init__(self, sets: DataFrame, fragments: int, threshold: int) -> None:
        self.threshold = threshold
        grams = sets.select("node", F.explode("grams").alias("g")).select("node", "g.*")
        cuts = grams.select(
            F.percentile_approx(_order_key(), [k / fragments for k in range(1, fragments)], 1000).alias("cuts")
        ).first()["cuts"]
        self.cuts = sorted(set(cuts or []))
        self.sets = sets

    def _cut(self, nodes: DataFrame) -> DataFrame:
        fragment = F.lit(0)
        for cut in self.cuts:
            fragment = fragment + (_order_key() >= F.lit(cut)).cast("int")
        return (
            self.sets.join(nodes, "node", "left_semi")
            .select("node", F.explode("grams").alias("g"))
            .select("node", "g.*")
            .groupBy("node", fragment.alias("fragment"))
            .agg(F.collect_list("gram").alias("part"))
        )

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(u, v, size_u, size_v)`` whose overlaps, summed over fragments, suffice."""
        nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        parts = self._cut(nodes)
        left = parts.select(F.col("node").alias("u"), "fragment", F.col("part").alias("part_u"))
        right = parts.select(F.col("node").alias("v"), "fragment", F.col("part").alias("part_v"))
        partial = (
            pairs.join(left, "u")
            .join(right, ["v", "fragment"])
            .select("u", "v", "size_u", "size_v", F.size(F.array_intersect("part_u", "part_v")).alias("partial"))
        )
        whole = partial.groupBy("u", "v", "size_u", "size_v").agg(F.sum("partial").alias("overlap"))
        union = F.col("size_u") + F.col("size_v") - F.col("overlap")
        return whole.where(F.col("overlap") * 100 >= union * self.threshold).select("u", "v")


def _prefixes(sets: DataFrame, threshold: int) -> DataFrame:
    """One row per n-gram of a prefix that another set may have in its own."""
    own = F.col("size") - F.col("shared")  # n-grams of no other set come first in the order
    length = _may_differ(F.col("size"), threshold) + 1 - own
    return (
        sets.where(length > 0)
        .select("node", "size", "shared", own.alias("own"), F.posexplode(F.slice("grams", 1, length.cast("int"))))
        .select(
            F.col("col.gram").alias("gram"),
            F.struct(
                (F.col("own") / F.col("size")).alias("apart"),
                "node",
                "size",
                "shared",
                (F.col("own") + F.col("pos")).alias("position"),
            ).alias("member"),
        )
    )


def _pairs(found: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    first = a["node"] < b["node"]
    return found.select(
        F.when(first, a["node"]).otherwise(b["node"]).alias("u"),
        F.when(first, b["node"]).otherwise(a["node"]).alias("v"),
        F.when(first, a["size"]).otherwise(b["size"]).alias("size_u"),
        F.when(first, b["size"]).otherwise(a["size"]).alias("size_v"),
    ).distinct()


def jaccard_components(
    docs: DataFrame,
    words: int = WORDS,
    threshold: int = THRESHOLD,
    fragments: int = FRAGMENTS,
    first_share: float = FIRST_SHARE,
) -> DataFrame:
    """Link documents whose sets of word n-grams have a Jaccard similarity of ``threshold`` percent.

    Words are lower-cased (A-Z) runs of characters other than ASCII white space. A text of fewer
    than ``words`` words is one n-gram; a null or blank one has none and links with nothing.

    Returns a row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest
    doc_id of the component, the own one included), ``component`` (a hash that names it, null
    without words) and ``text_key`` (xxhash64 of the text). Only ``doc_id`` and ``text`` are read. Rows are
    told apart by their texts: a repeated id gives a row each time, and rows without an id link
    like all others but name no component; if no row of a component has an id, its component_id is
    null. Hashes have 64 bits; two different sets are taken for equal with odds of 2**-64.

    Components are exact, but links are not listed: pairs that are already in one component are not
    tested again, so neither all linked pairs nor links per document follow from this.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    texts = docs.select("doc_id", "text")
    described = scratch.store(
        texts.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
            _describe(words, first_share),
            "doc_id long, text_key long, n_shingles long, n_first long, node long",
        ),
        "described",
    )
    classes = (
        described.where("node is not null")
        .groupBy("node")
        .agg(F.max("n_shingles").alias("size"), F.max("n_first").alias("n_first"), F.min("doc_id").alias("doc_id"))
    )

    sightings = texts.select("text").mapInArrow(
        _sightings(words, first_share), "key long, node long, seen int"
    )
    seen = (
        sightings.repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(tidy(_shared_counts), "node long, n_seen long")
        .groupBy("node")
        .agg(F.sum("n_seen").alias("n_seen"))
    )
    alone = F.col("n_first") - F.coalesce("n_seen", F.lit(0))
    likely = scratch.store(
        classes.join(seen, "node", "left")
        .where(alone <= _may_differ(F.col("size"), threshold))
        .select("node", "size", "doc_id"),
        "likely",
    )
    count = likely.count()

    wanted = maybe_broadcast(likely.select("doc_id").distinct(), count)
    sets = (
        texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
        .select("text")
        .mapInArrow(_whole_sets(words), "node long, grams array<long>")
        .join(maybe_broadcast(likely.select("node", "size"), count), "node")
    )
    # A repeated or missing id fetches more than the one text that was wanted.
    sets = scratch.store(sets.dropDuplicates(["node"]), "whole")

    grams = sets.select("node", F.explode("grams").alias("gram"))
    held_by = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("held_by")).where("held_by > 1")
    shared = (
        grams.join(held_by, "gram")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("held_by", "gram"))).alias("grams"))
    )
    ordered = scratch.store(
        shared.join(sets.select("node", "size"), "node").select(
            "node", "size", F.size("grams").cast("long").alias("shared"), "grams"
        ),
        "ordered",
    )
    scratch.drop("whole")

    cut = _Fragments(ordered, fragments, threshold)
    postings = _prefixes(ordered, threshold)
    central = (
        postings.groupBy("gram")
        .agg(F.min("member").alias("centre"), F.count(F.lit(1)).alias("members"))
        .where("members > 1")
        .select("gram", "centre")
    )
    members = scratch.store(postings.join(central, "gram"), "members")
    first_pairs = scratch.store(
        _pairs(
            members.where(F.col("member.node") != F.col("centre.node"))
            .where(_could_link("member", "centre", threshold))
            .select(F.col("centre").alias("a"), F.col("member").alias("b"))
        ),
        "first-pairs",
    )
    first_links = scratch.store(cut.linked(first_pairs), "first-links")
    joined = components(first_links, scratch, "first")

    # What is left: pairs of one posting that are in different components so far.
    rooted = members.join(
        joined.select(F.col("node").alias("in_node"), F.col("root").alias("in_root")),
        F.col("member.node") == F.col("in_node"),
        "left",
    ).select("gram", "member", "centre", F.coalesce("in_root", "member.node").alias("root"))
    centres = rooted.where(F.col("member.node") == F.col("centre.node")).select(
        "gram", F.col("root").alias("centre_root")
    )
    rooted = scratch.store(rooted.drop("centre").join(centres, "gram"), "rooted")
    outside = rooted.where(F.col("root") != F.col("centre_root")).select(
        "gram", F.col("member").alias("a"), F.col("root").alias("root_a")
    )
    others = rooted.select(
        "gram", F.col("member").alias("b"), F.col("root").alias("root_b"),
        (F.col("root") == F.col("centre_root")).alias("central"),
    )
    second_pairs = _pairs(
        outside.join(others, "gram")
        .where(F.col("root_a") != F.col("root_b"))
        .where(F.col("central") | (F.col("a.node") < F.col("b.node")))
        .where(_could_link("a", "b", threshold))
        .select("a", "b")
    ).join(first_pairs.select("u", "v"), ["u", "v"], "left_anti")
    second_pairs = scratch.store(second_pairs, "second-pairs")
    second_links = scratch.store(cut.linked(second_pairs), "second-links")
    scratch.drop("ordered", "members", "rooted")

    links = first_links.unionByName(second_links)
    named = components(links, scratch, "all")
    smallest = (
        named.join(classes.select("node", "doc_id"), "node", "left")
        .groupBy("root")
        .agg(F.min("doc_id").alias("component_id"))
    )
    of_class = classes.select("node", "doc_id").join(
        named.join(smallest, "root").select("node", "component_id", "root"), "node", "left"
    ).select(
        "node",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("root", "node").alias("component"),
    )
    return described.join(of_class, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "component",
        "text_key",
    )


def keep_one(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one of each component of ``linked``.

    What stays is the row with the smallest id, and of equal ids the one whose text hash is
    smallest; a row that repeats it goes. Documents without words link with nothing and all stay.
    Other columns may have any name; an empty table stays empty.
    """
    member = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    rows = linked.where("component is not null").groupBy("component", member.alias("member")).count()
    first = rows.groupBy("component").agg(F.min_by(F.struct("member", "count"), "member").alias("first"))
    kept = first.select("first.member.doc_id", "first.member.text_key", F.col("first.count").alias("copies"))
    wordless = linked.where("component is null").select("doc_id", "text_key").distinct()
    kept = Scratch(docs.sparkSession, "keep-one").store(
        kept.unionByName(wordless.select("doc_id", "text_key", F.lit(0).cast("long").alias("copies"))), "kept"
    )
    plain = set_apart(docs, "doc_id", "text")
    keyed = plain.withColumn("text_key", F.xxhash64("text"))

    def named(which: DataFrame) -> DataFrame:
        which = maybe_broadcast(which, which.count())
        same = keyed["doc_id"].eqNullSafe(which["doc_id"]) & (keyed["text_key"] == which["text_key"])
        return keyed.join(which, same, "left_semi")

    single = named(kept.where("copies < 2"))
    repeated = named(kept.where("copies > 1")).dropDuplicates(["doc_id", "text_key"])
    return put_back(single.unionByName(repeated), docs, "doc_id", "text")
