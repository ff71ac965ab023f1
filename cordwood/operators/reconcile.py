"""Compare what was accepted with what can be read back.

Both sides are stacked with a mark and counted per key. One aggregation with counting before the
shuffle replaces a join, and a key with very many copies stays one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _side_counts(accepted: DataFrame, visible: DataFrame, keys: Sequence[str]) -> DataFrame:
    def marked(df: DataFrame, a: int, v: int) -> DataFrame:
        return df.select(*keys, F.lit(a).alias("a"), F.lit(v).alias("v"))

    return (
        marked(accepted, 1, 0)
        .unionByName(marked(visible, 0, 1))
        .groupBy(*keys)
        .agg(F.sum("a").alias("accepted"), F.sum("v").alias("visible"))
    )


def visibility_columns(accepted: Column, visible: Column) -> dict[str, Column]:
    missing = F.greatest(F.lit(0), accepted - visible)
    share = F.least(F.lit(1.0), F.round(visible / F.nullif(accepted, F.lit(0)), 4))
    return {
        "missing_records": missing,
        "duplicate_records": F.greatest(F.lit(0), visible - accepted),
        "visibility_rate": F.when(accepted > 0, share).otherwise(1.0),
        "consistency_passed": missing == 0,
    }


def count_check(accepted: DataFrame, visible: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: records accepted, visible, missing and surplus. Counts alone: see ``copy_counts``."""
    counts = _side_counts(accepted, visible, keys)
    derived = visibility_columns(F.col("accepted"), F.col("visible"))
    return counts.select(
        *keys,
        F.col("accepted").alias("accepted_records"),
        F.col("visible").alias("visible_records"),
        *[column.alias(name) for name, column in derived.items()],
    )


def copy_counts(accepted: DataFrame, visible: DataFrame) -> DataFrame:
    """Copies of every (id, message) on either side.

    A loss that a repeat makes up for is invisible to counts per run, and visible here.
    """
    return _side_counts(accepted, visible, ["id", "message"])


def missing_rows(copies: DataFrame) -> DataFrame:
    return copies.where(F.col("visible") < F.col("accepted")).select(
        "id", "message", (F.col("accepted") - F.col("visible")).alias("missing")
    )


def surplus_rows(copies: DataFrame) -> DataFrame:
    return copies.where(F.col("visible") > F.col("accepted")).select(
        "id", "message", (F.col("visible") - F.col("accepted")).alias("surplus")
    )


def set_check(copies: DataFrame) -> DataFrame:
    """One row: does the visible set equal the accepted one, and by how much not."""
    difference = F.col("accepted") - F.col("visible")
    total = [
        F.coalesce(F.sum(F.greatest(difference, F.lit(0))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.greatest(-difference, F.lit(0))), F.lit(0)).alias("surplus"),
    ]
    return copies.agg(*total).withColumn(
        "passed", (F.col("missing") == 0) & (F.col("surplus") == 0)
    )


def distinct_ids(df: DataFrame) -> DataFrame:
    """Rows, distinct ids, and whether no id repeats; ids are merged before they are counted."""
    return (
        df.groupBy("id")
        .agg(F.count(F.lit(1)).alias("copies"))
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
            F.count(F.lit(1)).alias("distinct_ids"),
        )
        .withColumn("all_distinct", F.col("rows") == F.col("distinct_ids"))
    )


PROBE_SERVICE = "consistency-probe"


def read_after_write(
    probes: DataFrame, logs: DataFrame, keys: Sequence[str], service: str = PROBE_SERVICE
) -> DataFrame:
    """Per key: probes sent, probes whose message is readable under the probe service, the rate."""
    sent = probes.groupBy(*keys, "message").agg(F.count(F.lit(1)).alias("probes"))
    stored = logs.where(F.col("service") == service).select("message").distinct()
    # Both sides hold each message once per key, so no message is heavier than another.
    found = stored.withColumn("found", F.lit(1))
    passed = F.sum(F.when(F.col("found").isNotNull(), F.col("probes")).otherwise(0))
    rate = F.col("probes_passed") / F.greatest(F.lit(1), F.col("probes_total"))
    return (
        sent.join(found, "message", "left")
        .groupBy(*keys)
        .agg(F.sum("probes").alias("probes_total"), passed.alias("probes_passed"))
        .withColumn("read_after_write_rate", F.round(rate, 4))
    )
