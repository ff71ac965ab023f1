"""Quantiles from stored sketches, and exact ones by narrowing what a sketch encloses.

A KLL sketch of the values of each minute and key is small and can be merged, so any range of time
has its sketch without a look at the rows. It encloses a wanted rank between two values. One pass
over the rows counts what lies below and inside; while more lies inside than one task should hold,
a sketch of what is inside gives closer values and the pass is made again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordwood.functions.times import bucket_start
from cordwood.operators.percentile import small_side
from cordwood.sources.log_table import DayTable

# Size parameter of the sketches, and the share of ranks by which one may be off: with 1 part in
# 100 the odds of more are below one in a hundred, and then the next pass finds it.
SKETCH_SIZE, MARGIN = 400, 0.012
# Steps in which ranks are read from a sketch.
STEPS = 200
# Rows of one group between the ends of its bracket, whose distinct values one task may sort.
MAX_INSIDE = 50_000
MAX_PASSES = 60


def quantile_table(spark: SparkSession, path: str, keys: Sequence[str]) -> DayTable:
    """A table of sketches by minute and keys (strings); merged batches have merged sketches."""
    schema = T.StructType(
        [
            T.StructField("start", T.TimestampNTZType()),
            *(T.StructField(key, T.StringType()) for key in keys),
            T.StructField("sketch", T.BinaryType()),
        ]
    )

    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy("dt", "batch", "start", *keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))

    return DayTable(spark, path, schema, "start", ("start",), fold)


def quantile_sketches(rows: DataFrame, keys: Sequence[str], value: str, time: str = "timestamp") -> DataFrame:
    """One sketch per minute of ``time`` and ``keys``; null and NaN values are left out."""
    number = F.col(value).cast("double")
    return (
        rows.where(number.isNotNull() & ~F.isnan(number))
        .groupBy(bucket_start(F.col(time), "1m").alias("start"), *keys)
        .agg(F.kll_sketch_agg_double(number, SKETCH_SIZE).alias("sketch"))
    )


def merged_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One sketch per key over all minutes at hand."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def estimated_quantile(sketches: DataFrame, keys: Sequence[str], fraction: float) -> DataFrame:
    """``keys``, ``rows`` and ``quantile``, which is off by ``MARGIN`` of the ranks at most, mostly."""
    found = F.kll_sketch_get_quantile_double("sketch", F.lit(fraction)).alias("quantile")
    return merged_sketches(sketches, keys).select(*keys, F.kll_sketch_get_n_double("sketch").alias("rows"), found)


def _enclosed(sketch: Column, below: Column, above: Column) -> tuple[Column, Column]:
    """Values of a sketch that enclose two shares of its ranks, read at fixed steps."""
    values = F.kll_sketch_get_quantile_double(sketch, F.array(*(F.lit(k / STEPS) for k in range(STEPS + 1))))
    first = F.greatest(F.floor((below - MARGIN) * STEPS), F.lit(0))
    last = F.least(F.ceil((above + MARGIN) * STEPS), F.lit(STEPS))
    return F.get(values, first.cast("int")), F.get(values, last.cast("int"))


def brackets(
    rows: DataFrame, keys: Sequence[str], value: str, fraction: float, sketches: DataFrame, max_inside: int = MAX_INSIDE
) -> DataFrame:
    """Per key the values ``lo`` and ``hi`` that enclose the ranks of a quantile.

    Columns: keys, n (rows of the key), lo, hi, below (rows under ``lo``), between (rows over ``lo`` and
    under ``hi``, ``max_inside`` at most). ``sketches`` must be of the same rows. Each pass writes one
    row per key, and leaves a few parts in a hundred of what was between.
    """
    keys = list(keys)
    numbers = _numbers(rows, keys, value)
    merged = merged_sketches(sketches, keys)
    position = F.lit(fraction) * (F.col("n") - 1)
    lo, hi = _enclosed(F.col("sketch"), F.lit(fraction), F.lit(fraction))
    state = small_side(
        merged.select(*keys, F.kll_sketch_get_n_double("sketch").alias("n"), lo.alias("lo"), hi.alias("hi")).withColumn(
            "settled", F.lit(False)
        )
    )
    v, lo, hi, below, between = (F.col(name) for name in ("v", "lo", "hi", "below", "between"))
    first, last = F.floor(position), F.ceil(position)
    for _ in range(MAX_PASSES):
        inner = (v > lo) & (v < hi)
        measured = (
            _joined(numbers, state, keys)
            .groupBy(*keys, "n", "lo", "hi", "settled")
            .agg(
                F.count_if(v < lo).alias("below"),
                F.count_if(v == lo).alias("at_lo"),
                F.count_if(inner).alias("between"),
                F.count_if((v == hi) & (hi > lo)).alias("at_hi"),
                F.kll_sketch_agg_double(F.when(inner & ~F.col("settled"), v), SKETCH_SIZE).alias("sketch"),
            )
        )
        over_lo = below + F.col("at_lo")
        over_inner = over_lo + between
        high, low = below > first, over_inner + F.col("at_hi") <= last
        # Ranks that are ties of an end need nothing from the other side of them.
        only_lo, only_hi = last < over_lo, first >= over_inner
        settled = ~high & ~low & ((between <= max_inside) | F.col("settled"))
        nearer = _enclosed(F.col("sketch"), (first - over_lo) / between, (last - over_lo + 1) / between)
        # A sketch that was wrong is opened on that side; the next pass closes in again.
        state = small_side(
            measured.select(
                *keys, "n", "below", "between", settled.alias("settled"),
                F.when(high, F.lit(float("-inf"))).when(low | settled | (first < over_lo), lo).when(only_hi, hi)
                .otherwise(nearer[0]).alias("lo"),
                F.when(low, F.lit(float("inf"))).when(high | settled | (last >= over_inner), hi).when(only_lo, lo)
                .otherwise(nearer[1]).alias("hi"),
            )
        )
        if not state.where(~F.col("settled")).limit(1).count():
            return state.drop("settled")
    raise RuntimeError("the brackets of a quantile did not close")


def _numbers(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    number = F.col(value).cast("double")
    return rows.where(number.isNotNull() & ~F.isnan(number)).select(*keys, number.alias("v"))


def _joined(numbers: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Numbers beside the state of their key; keys may be null."""
    renamed = state.drop("below", "between")
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_{key}")
    same = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys], F.lit(True))
    return numbers.join(renamed, same).drop(*(f"_{key}" for key in keys))


def exact_quantile(
    rows: DataFrame, keys: Sequence[str], value: str, fraction: float, sketches: DataFrame, max_inside: int = MAX_INSIDE
) -> DataFrame:
    """``keys`` and ``quantile``: linear interpolation between the two nearest ranks, exactly.

    ``sketches`` are those of the same rows, by minute or merged. What is sorted at the end is the
    distinct values of each bracket, ``max_inside`` and its two ends at most.
    """
    keys = list(keys)
    found = brackets(rows, keys, value, fraction, sketches, max_inside)
    counted = (
        _joined(_numbers(rows, keys, value), found, keys)
        .where(F.col("v").between(F.col("lo"), F.col("hi")))
        .groupBy(*keys, "n", "v")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    starts = found.select(*(F.col(key).alias(f"_{key}") for key in keys), "below")
    same = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys], F.lit(True))
    running = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("below") + F.sum("copies").over(running)
    placed = counted.join(starts, same).withColumn("end", end).withColumn("begin", F.col("end") - F.col("copies"))
    position = F.lit(fraction) * (F.col("n") - 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("begin") <= rank) & (rank < F.col("end")), F.col("v")))

    lower, upper = at(F.floor(position)), at(F.ceil(position))
    share = F.max(position - F.floor(position))
    return placed.groupBy(*keys).agg((lower + (upper - lower) * share).alias("quantile"))
