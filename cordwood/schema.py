"""Schemas of the log table, of ingest envelopes and of the tables written beside them."""

from __future__ import annotations

from pyspark.sql import types as T

LEVELS = ("debug", "info", "warn", "error")

ATTRIBUTES = T.MapType(T.StringType(), T.StringType(), valueContainsNull=False)

LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampNTZType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("service", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("attributes", ATTRIBUTES, False),
    ]
)
LOG_COLUMNS = LOG_SCHEMA.fieldNames()

# One row per request; ``received_at`` is the clock the future bound is checked against, so a
# replayed request is judged as it was the first time.
ENVELOPE_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.StringType(), False),
        T.StructField("body", T.StringType(), True),
        T.StructField("received_at", T.TimestampNTZType(), False),
    ]
)

REJECT_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("index", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("received_at", T.TimestampNTZType()),
    ]
)

RECEIPT_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("accepted", T.IntegerType()),
        T.StructField(
            "rejected",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("index", T.IntegerType()),
                        T.StructField("reason", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("received_at", T.TimestampNTZType()),
    ]
)

ROLLUP_SCHEMA = T.StructType(
    [
        T.StructField("start", T.TimestampNTZType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("count", T.LongType()),
    ]
)

# Tables are laid out as dt=<day>/batch=<writer and batch number>.
PARTITION_FIELDS = [
    T.StructField("dt", T.DateType()),
    T.StructField("batch", T.StringType()),
]


def with_partitions(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + PARTITION_FIELDS)
