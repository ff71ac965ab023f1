"""Bucket counts kept up to date by a stream."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cordwood.functions.times import BUCKETS
from cordwood.sources.log_table import DayTable

COUNTS_SCHEMA = T.StructType(
    [
        T.StructField("start", T.TimestampNTZType()),
        T.StructField("group", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("version", T.LongType()),
    ]
)


def _latest(rows: DataFrame) -> DataFrame:
    latest = [F.max_by("count", "version").alias("count"), F.max("version").alias("version")]
    return rows.groupBy("dt", "batch", "start", "group").agg(*latest)


def counts_table(spark: SparkSession, path: str) -> DayTable:
    """The log of changed counters: by day of their bucket and micro-batch.

    Merged batches keep the latest value of each counter, so that a counter has a row for each
    micro-batch since the last merge and one more, however long the stream has run.
    """
    return DayTable(spark, path, COUNTS_SCHEMA, "start", ("start", "group"), _latest)


def running_counts(logs: DataFrame, bucket: str, group_by: str | None = None) -> DataFrame:
    """Counts per bucket and group over a stream of logs; for update or complete mode.

    Logs of any age count, so there is no watermark: state is one counter per bucket and group
    that has logs, as many rows as the result.
    """
    group = F.col(group_by) if group_by else F.lit(None).cast("string")
    # Windows need the zoned type; the session zone is UTC.
    zoned = logs.withColumn("event_time", F.col("timestamp").cast("timestamp"))
    return (
        zoned.groupBy(F.window("event_time", BUCKETS[bucket]).alias("window"), group.alias("group"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("start"), "group", "count")
    )


def start_counts(
    counts: DataFrame,
    table: DayTable,
    checkpoint: str,
    name: str = "counts",
    merge_every: int = 50,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Write the counters each micro-batch changed; a repeated micro-batch replaces its own.

    After every ``merge_every`` micro-batches their rows are folded; the last one is spared, as it
    may come again.
    """

    def save(changed: DataFrame, number: int) -> None:
        batch = f"{name}-{number}"
        table.write(changed.withColumn("version", F.lit(number).cast("bigint")), batch)
        if number % merge_every == merge_every - 1:
            table.merge(date.max, {batch})

    writer = (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
    )
    if processing_time is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=processing_time).start()


def current_counts(saved: DataFrame) -> DataFrame:
    """The latest value of every counter."""
    return saved.groupBy("start", "group").agg(F.max_by("count", "version").alias("count"))
