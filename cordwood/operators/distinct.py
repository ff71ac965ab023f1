"""Distinct values over any range of time, from theta sketches by day that can be combined.

A sketch of the distinct values of each day and key is stored once. Union, intersection and
difference of ranges of days then read sketches alone; the estimate comes with the distance within
which the exact number lies in all but about one case in a hundred, and the exact count stands
beside it for whoever needs it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordwood.functions.times import bucket_start
from cordwood.sources.log_table import DayTable

# Two to the power of this many values are kept; up to as many the sketch is exact.
LOG_ENTRIES = 14


def distinct_table(spark: SparkSession, path: str, keys: Sequence[str]) -> DayTable:
    """A table of sketches by day and keys (strings); merged batches have united sketches."""
    schema = T.StructType(
        [
            T.StructField("start", T.TimestampNTZType()),
            *(T.StructField(key, T.StringType()) for key in keys),
            T.StructField("sketch", T.BinaryType()),
        ]
    )

    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy("dt", "batch", "start", *keys).agg(F.theta_union_agg("sketch", LOG_ENTRIES).alias("sketch"))

    return DayTable(spark, path, schema, "start", ("start",), fold)


def distinct_sketches(rows: DataFrame, keys: Sequence[str], value: str, time: str = "timestamp") -> DataFrame:
    """One sketch per day of ``time`` and ``keys``; nulls are no value."""
    return rows.groupBy(bucket_start(F.col(time), "1d").alias("start"), *keys).agg(
        F.theta_sketch_agg(F.col(value), LOG_ENTRIES).alias("sketch")
    )


def compared_ranges(sketches: DataFrame, keys: Sequence[str], first: Column, second: Column) -> DataFrame:
    """Per key the values of two sets of days: in the first, the second, either, both, the first alone.

    ``first`` and ``second`` say which sketches belong to a range. ``bound`` is the distance from the
    exact numbers that three standard errors of the union allow, 0 while the sketches are exact.
    """

    def united(which: Column) -> Column:
        return F.theta_union_agg(F.when(which, F.col("sketch")), LOG_ENTRIES)

    merged = sketches.where(first | second).groupBy(*keys).agg(
        united(first).alias("a"), united(second).alias("b"), united(first | second).alias("both_ranges")
    )

    def size(sketch: Column) -> Column:
        return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0)).cast("long")

    a, b = F.col("a"), F.col("b")
    either = size(F.col("both_ranges"))
    entries = 1 << LOG_ENTRIES
    return merged.select(
        *keys,
        size(a).alias("in_first"),
        size(b).alias("in_second"),
        either.alias("in_either"),
        size(F.theta_intersection(a, b)).alias("in_both"),
        size(F.theta_difference(a, b)).alias("only_first"),
        F.when(either < entries, 0).otherwise(F.ceil(either * (3.0 / entries**0.5))).cast("long").alias("bound"),
    )


def exact_ranges(rows: DataFrame, keys: Sequence[str], value: str, first: Column, second: Column) -> DataFrame:
    """The same numbers from the rows themselves, counted once per key and value."""
    once = (
        rows.where((first | second) & F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.bool_or(first).alias("a"), F.bool_or(second).alias("b"))
    )
    a, b = F.col("a"), F.col("b")
    return once.groupBy(*keys).agg(
        F.count_if(a).alias("in_first"),
        F.count_if(b).alias("in_second"),
        F.count(F.lit(1)).alias("in_either"),
        F.count_if(a & b).alias("in_both"),
        F.count_if(a & ~b).alias("only_first"),
    )
