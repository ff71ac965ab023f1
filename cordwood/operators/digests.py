"""Two sets of rows compared by digests, so that only what differs is read.

Each side keeps, per day and prefix of a hash of the id, how many rows it has, the sum of a hash, and
the exclusive or of another one. Digests add up: batches to days, prefixes to shorter ones. A
comparison goes down from days to prefixes and reads rows only under prefixes that differ; equal
sides of any size are told equal from two small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordwood.functions.times import bucket_start
from cordwood.operators.filters import where_all
from cordwood.operators.percentile import small_side
from cordwood.sources.log_table import DayTable

# Bits of the hash that name a leaf of a day; the tree above it is a day, as leaves are few.
LEAF_BITS = 14

DIGEST_SCHEMA = T.StructType(
    [
        T.StructField("start", T.TimestampNTZType()),
        T.StructField("leaf", T.IntegerType()),
        T.StructField("rows", T.LongType()),
        T.StructField("total", T.DecimalType(38, 0)),
        T.StructField("mixed", T.LongType()),
    ]
)
_DIGEST = ["rows", "total", "mixed"]


def _leaf(id_: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(id_), 64 - LEAF_BITS).cast("int")


def _added(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        F.sum("total").cast("decimal(38,0)").alias("total"),
        F.bit_xor("mixed").alias("mixed"),
    )


def digests(logs: DataFrame) -> DataFrame:
    """Digests of the ids of some logs by day and leaf; each copy of an id counts."""
    mixed = F.xxhash64("id", F.lit("mixed"))
    each = logs.select(
        bucket_start(F.col("timestamp"), "1d").alias("start"), _leaf(F.col("id")).alias("leaf"),
        F.lit(1).cast("long").alias("rows"), mixed.cast("decimal(38,0)").alias("total"), mixed.alias("mixed"),
    )
    return _added(each, "start", "leaf")


def digest_table(spark: SparkSession, path: str) -> DayTable:
    """A table of digests; merged batches are added up."""
    return DayTable(
        spark, path, DIGEST_SCHEMA, "start", ("start", "leaf"), lambda rows: _added(rows, "dt", "batch", "start", "leaf")
    )


def _apart(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """The keys whose digests are not the same on both sides."""
    a, b = _added(left, *keys), _added(right, *keys)
    # Subtracted rather than joined: a key that only one side has differs from nothing.
    signed = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2)))
    same = F.lit(True)
    for name in _DIGEST:
        one, two = (F.max(F.when(F.col("side") == side, F.col(name))) for side in (1, 2))
        same &= one.eqNullSafe(two)
    return signed.groupBy(*keys).agg(same.alias("same")).where(~F.col("same")).drop("same")


def differing_leaves(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(start, leaf)`` where two tables of digests differ; leaves of equal days are not compared."""
    days = small_side(_apart(left, right, "start"))
    open_left, open_right = (side.join(days, "start", "left_semi") for side in (left, right))
    return _apart(open_left, open_right, "start", "leaf")


def differences(expected: DataFrame, found: DataFrame, leaves: DataFrame) -> DataFrame:
    """``(id, expected, found)``: how often each side has an id, for ids in which they differ.

    ``leaves`` are those of ``differing_leaves``. Only rows of their days are read, and of those only
    the ones in such a leaf go on; without any, no row is read.
    """
    leaves = small_side(leaves)
    span = leaves.agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("start").alias("last")).first()
    if not span["n"]:
        return expected.select("id", F.lit(0).cast("long").alias("expected"), F.lit(0).cast("long").alias("found")).limit(0)
    days = [row["day"] for row in leaves.select(F.to_date("start").cast("string").alias("day")).distinct().collect()]

    def inside(rows: DataFrame, side: str) -> DataFrame:
        start = bucket_start(F.col("timestamp"), "1d")
        bounds = [F.col("timestamp") >= F.lit(span["first"]), F.col("timestamp") < F.lit(span["last"]) + F.expr("INTERVAL 1 DAY")]
        if "dt" in rows.columns:
            bounds.append(F.col("dt").cast("string").isin(days))
        near = where_all(rows, bounds).select("id", start.alias("start"), _leaf(F.col("id")).alias("leaf"))
        return near.join(leaves, ["start", "leaf"], "left_semi").select("id", F.lit(side).alias("side"))

    both = inside(expected, "expected").unionByName(inside(found, "found"))
    counted = both.groupBy("id").agg(
        F.count_if(F.col("side") == "expected").alias("expected"), F.count_if(F.col("side") == "found").alias("found")
    )
    return counted.where("expected <> found")
