"""Time expressions: literals, ISO text, bucket floors."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket names of the aggregate query and their widths.
BUCKETS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}

# A UTC datetime: calendar date, hour and minute, optional seconds with any number of fraction
# digits, and a literal Z. Whether the day exists in its month is left to the cast.
ISO_UTC = (
    r"\A\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"
    r"T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?Z\z"
)

ISO_OUTPUT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def instant(value: datetime) -> Column:
    """A UTC datetime as a foldable TIMESTAMP_NTZ, so that predicates on it reach the scan."""
    return F.lit(value.isoformat(sep=" ", timespec="microseconds")).cast("timestamp_ntz")


def parse_iso(text: str) -> str:
    """SQL for ISO-Z text to a TIMESTAMP_NTZ cut to milliseconds; NULL where it is no datetime."""
    # 23 characters reach exactly to the third fraction digit.
    return f"""
      CASE WHEN {text} RLIKE r'{ISO_UTC}' THEN try_cast(
        CASE WHEN length({text}) = 17 THEN substring({text}, 1, 16) || ':00'
             ELSE rtrim('Z', substring({text}, 1, 23)) END AS TIMESTAMP_NTZ) END"""


def format_iso(ts: Column) -> Column:
    return F.date_format(ts, ISO_OUTPUT)


def to_millis(ts: Column) -> Column:
    return F.date_trunc("millisecond", ts).cast("timestamp_ntz")


def bucket_start(ts: Column, bucket: str) -> Column:
    """Start of the tumbling UTC bucket: integer arithmetic inside code generation."""
    return F.window(ts, BUCKETS[bucket])["start"]
