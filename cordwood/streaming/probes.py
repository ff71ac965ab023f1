"""Read-after-write probes answered as they happen: an outer interval join of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cordwood.sources.log_table import DayTable

OUTCOME_SCHEMA = T.StructType(
    [
        T.StructField("probe_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("sent_at", T.TimestampNTZType()),
        T.StructField("seen_at", T.TimestampNTZType()),
    ]
)


def probe_outcomes(probes: DataFrame, logs: DataFrame, within: str = "30 seconds", late: str = "10 seconds") -> DataFrame:
    """Each probe with the first look at its message that came in time, or with none.

    ``probes``: probe_id, run_id, message, sent_at; ``logs``: message, seen_at. A probe is answered
    by a log with its message seen from ``sent_at`` to ``within`` later, and given up once both
    streams are past that by ``late``: rows that come later than that are not waited for, and state
    holds no more than that span of either stream. A probe has a row for each log that answers it.
    """
    zoned = probes.select("probe_id", "run_id", "message", F.col("sent_at").cast("timestamp").alias("sent"))
    looked = logs.select(F.col("message").alias("shown"), F.col("seen_at").cast("timestamp").alias("seen"))
    sent, seen = zoned.withWatermark("sent", late), looked.withWatermark("seen", late)
    in_time = F.expr(f"message = shown AND seen >= sent AND seen <= sent + INTERVAL {within}")
    return sent.join(seen, in_time, "left_outer").select(
        "probe_id", "run_id", F.col("sent").cast("timestamp_ntz").alias("sent_at"), F.col("seen").cast("timestamp_ntz").alias("seen_at")
    )


def outcome_table(spark: SparkSession, path: str) -> DayTable:
    return DayTable(spark, path, OUTCOME_SCHEMA, "sent_at", ("sent_at", "probe_id"))


def start_outcomes(
    outcomes: DataFrame, table: DayTable, checkpoint: str, name: str = "probes", processing_time: str | None = None
) -> StreamingQuery:
    """Store outcomes as they are known; a repeated micro-batch replaces its own."""
    writer = (
        outcomes.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda rows, number: table.write(rows, f"{name}-{number}"))
    )
    if processing_time is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=processing_time).start()


def answered_rates(outcomes: DataFrame) -> DataFrame:
    """Per run: probes settled, those answered, their rate, and the longest wait of an answered one."""
    wait = F.unix_micros(F.col("seen_at").cast("timestamp")) - F.unix_micros(F.col("sent_at").cast("timestamp"))
    each = outcomes.groupBy("run_id", "probe_id").agg(F.min(wait).alias("waited"))
    passed = F.count("waited")
    return each.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("probes_total"),
        passed.alias("probes_passed"),
        F.round(passed / F.greatest(F.lit(1), F.count(F.lit(1))), 4).alias("read_after_write_rate"),
        F.max(F.col("waited") / 1000).alias("longest_wait_ms"),
    )
