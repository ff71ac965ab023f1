"""Exact interpolated percentiles without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cordwood.session import shared_dir

# A table joined by broadcast has at most this many rows of a few scalars each.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write ``df`` to the checkpoint folder once; mark it for broadcast if its count allows."""
    shared_dir(df.sparkSession)
    stored = df.checkpoint()
    return F.broadcast(stored) if stored.limit(max_rows + 1).count() <= max_rows else stored


def exact_percentile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fraction: float,
    accuracy: int = 10_000,
) -> DataFrame:
    """``keys`` and ``percentile``: linear interpolation between the two nearest ranks.

    Spark's ``percentile`` holds every distinct value of a group in one buffer. Here a first pass
    takes a mergeable sketch per group, which encloses the wanted ranks between two values. A
    second pass counts what lies below and only keeps the distinct values in between, a few parts
    in ``accuracy`` of the group, to find the ranks among them. All counting starts before the
    shuffle, so a group that holds most rows costs no more than the others.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    margin = 4.0 / accuracy
    ends = [max(fraction - margin, 0.0), min(fraction + margin, 1.0)]
    sketch = F.percentile_approx("v", ends, accuracy)
    # Up to ``accuracy`` rows the margin may be less than a rank, and the whole group is little.
    few = F.col("n") <= accuracy
    brackets = small_side(
        rows.groupBy(*keys)
        .agg(
            F.count("v").alias("n"),
            sketch.alias("ends"),
            F.min("v").alias("least"),
            F.max("v").alias("most"),
        )
        .select(
            *[F.col(key).alias(f"b_{key}") for key in keys],
            "n",
            F.when(few, F.col("least")).otherwise(F.col("ends")[0]).alias("lo"),
            F.when(few, F.col("most")).otherwise(F.col("ends")[1]).alias("hi"),
        )
    )
    # NULL stands for everything below the bracket and sorts first.
    # Keys may be NULL.
    same = reduce(and_, [F.col(key).eqNullSafe(F.col(f"b_{key}")) for key in keys], F.lit(True))
    counted = (
        rows.join(brackets, same)
        .where(F.col("v") <= F.col("hi"))
        .groupBy(*keys, "n", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v"))
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    running = (
        Window.partitionBy(*keys)
        .orderBy(F.col("v").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    position = F.lit(fraction) * (F.col("n") - 1)
    placed = counted.withColumn("end", F.sum("copies").over(running)).withColumns(
        {"position": position, "begin": F.col("end") - F.col("copies")}
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("begin") <= rank) & (rank < F.col("end")), F.col("v")))

    return (
        placed.groupBy(*keys)
        .agg(
            F.first("position").alias("position"),
            at(F.floor("position")).alias("lower"),
            at(F.ceil("position")).alias("upper"),
        )
        .select(
            *keys,
            F.when(
                F.col("lower").isNull() | F.col("upper").isNull(),
                F.raise_error(F.lit("rank outside its bracket")).cast("double"),
            )
            .otherwise(
                F.col("lower")
                + (F.col("upper") - F.col("lower")) * (F.col("position") - F.floor("position"))
            )
            .alias("percentile"),
        )
    )
