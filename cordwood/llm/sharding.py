"""Sharding by weighted rendezvous hashing, on DataFrame functions alone.

Each shard draws a number from the hash of its own number and the record's key; the largest draw
wins. A draw depends on no other shard, so a new shard only takes the records that it wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordwood.llm.common import Scratch

# Rows that one window group numbers at most, on average.
GROUP_ROWS = 2_000
# Equal rows that one task writes out again at once.
CHUNK_ROWS = 10_000


def _draw(key: Column, shard: int, weight: float) -> Column:
    """The larger, the better: -weight / ln(u) for u uniform between 0 and 1."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(shard), key), 11).cast("double")
    uniform = (bits + 0.5) / float(1 << 53)
    return F.struct((F.lit(-float(weight)) / F.ln(uniform)).alias("draw"), F.lit(shard).alias("shard"))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among shards 0, 1, … of these weights; a null key is a key like others."""
    draws = [_draw(key, shard, weight) for shard, weight in enumerate(weights) if weight > 0]
    if not draws:
        raise ValueError("at least one shard must have a positive weight")
    best = F.greatest(*draws) if len(draws) > 1 else draws[0]
    return best["shard"]


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """All rows with a ``slot``, counted from 0 without gaps in each ``group``.

    Equal rows are counted before they are shuffled and written out again in chunks, so a row that
    makes up most of the table is no task's whole work. Groups are numbered in parts by hash; only
    the sizes of the parts are summed up per group. Slots follow no order beyond that.
    """
    scratch = Scratch(rows.sparkSession, "numbered")
    columns = rows.columns
    counted = scratch.store(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")), "counted")
    sizes = counted.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    parts = max(1, sizes // GROUP_ROWS)
    spread = counted.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    by = ", ".join(order)
    before_part = spread.groupBy(group, "_part").agg(F.sum("_n").alias("_size")).selectExpr(
        group,
        "_part",
        f"sum(_size) OVER (PARTITION BY {group} ORDER BY _part) - _size AS _before",
    )
    begun = spread.selectExpr(
        "*", f"sum(_n) OVER (PARTITION BY {group}, _part ORDER BY {by} ROWS UNBOUNDED PRECEDING) - _n AS _within"
    ).join(before_part, [group, "_part"])
    chunks = begun.select(
        *columns,
        "_n",
        (F.col("_before") + F.col("_within")).alias("_first"),
        F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_n") - 1), F.lit(CHUNK_ROWS).cast("long"))).alias("_chunk"),
    )
    single = chunks.where("_n = 1").select(*columns, F.col("_first").alias("slot"))
    last = F.least(F.col("_chunk") + CHUNK_ROWS, F.col("_n")) - 1
    copies = (
        chunks.where("_n > 1")
        .repartition("_first", "_chunk")
        .select(*columns, F.explode(F.sequence(F.col("_first") + F.col("_chunk"), F.col("_first") + last)).alias("slot"))
    )
    return single.unionByName(copies)


def shard_documents(docs: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Shard, size and slot of every document, keyed by doc_id.

    Returns a row per row of ``docs``: doc_id, size (UTF-8 bytes of the text, none for null, plus
    8), text_crc32, law (``key``), shard, slot (from 0 without gaps in a shard), grown_shard (with
    one more shard of mean weight). Only doc_id and text are read. Rows with the same id, or
    without one, share a shard; equal rows have different slots.
    An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    grown = [*weights, sum(weights) / len(weights)]
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
        shard_of(F.col("doc_id"), grown).alias("grown_shard"),
    )
    return numbered(rows, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def write_shards(df: DataFrame, key: str, weights: Sequence[float], path: str, files: int) -> None:
    """Write all columns of ``df`` as Parquet, a folder per shard with at most ``files`` files."""
    salted = df.withColumn("shard", shard_of(F.col(key), weights)).withColumn(
        "_salt", F.pmod(F.xxhash64(*df.columns), F.lit(files))
    )
    salted.repartition("shard", "_salt").drop("_salt").write.partitionBy("shard").parquet(path)
