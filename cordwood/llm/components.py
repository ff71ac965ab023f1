"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the edge table, so nothing is held per component and
a star with very many leaves is pre-aggregated before its shuffle. The edge table is written after
every round; rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordwood.llm.common import Scratch


def _linked_to_smallest(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them and the node itself.

    ``larger_only`` takes all neighbours and links the larger ones (large star); otherwise only
    the smaller neighbours and the node are linked (small star).
    """
    forward = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if larger_only:
        around = forward.unionByName(forward.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = around.groupBy("u").agg(F.min("v").alias("m"))
        joined = forward.select(F.col("v").alias("u"), F.col("u").alias("x")).join(smallest, "u")
        return joined.select(F.col("x").alias("u"), F.least("m", "u").alias("v")).distinct()
    smallest = forward.groupBy("u").agg(F.min("v").alias("m"))
    moved = forward.join(smallest, "u").where(F.col("v") != F.col("m")).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    own = smallest.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).distinct()


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """``(node, root)`` of every node with an edge; the root is the smallest node it can reach.

    ``edges`` has two columns ``u`` and ``v`` of one orderable type. Edges with a null end and
    loops are left out. No edges give no rows.
    """
    current = scratch.store(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        f"{label}-0",
    )
    state, turn = None, 0
    while True:
        turn += 1
        stars = _linked_to_smallest(_linked_to_smallest(current, True), False)
        current = scratch.store(stars, f"{label}-{turn}")
        seen = current.agg(
            F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.hash("u", "v").cast("long"))
        ).first()
        scratch.drop(f"{label}-{turn - 1}")
        if seen == state:
            break
        state = seen
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.unionByName(roots)
