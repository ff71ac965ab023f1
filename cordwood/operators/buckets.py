"""Time-bucket counts, their totals, and the same counts answered from a minute rollup."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordwood.functions.times import bucket_start, instant
from cordwood.operators.filters import day_predicates, field_predicates, select_rows, where_all
from cordwood.plans.params import BucketQuery

MINUTE = timedelta(minutes=1)


def _group(query: BucketQuery) -> Column:
    return F.col(query.group_by) if query.group_by else F.lit(None).cast("string")


def _ordered(counts: DataFrame) -> DataFrame:
    return counts.orderBy("start", "group")


def bucket_counts(df: DataFrame, query: BucketQuery) -> DataFrame:
    """Rows per bucket and optional group; buckets without rows do not appear.

    Tasks count before the shuffle, so what moves is one row per task, bucket and group, however
    the logs are spread over services.
    """
    return _ordered(
        select_rows(df, query)
        .groupBy(
            bucket_start(F.col("timestamp"), query.bucket).alias("start"),
            _group(query).alias("group"),
        )
        .agg(F.count(F.lit(1)).alias("count"))
    )


def bucket_total(counts: DataFrame) -> DataFrame:
    """Number of rows behind some bucket counts."""
    return counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"))


def group_totals(counts: DataFrame) -> DataFrame:
    """Bucket counts folded over time."""
    return counts.groupBy("group").agg(F.sum("count").alias("total"))


def minute_rollup(df: DataFrame) -> DataFrame:
    """Counts by minute, service and level: the finest grain the bucket query can group by."""
    return df.groupBy(
        bucket_start(F.col("timestamp"), "1m").alias("start"), "service", "level"
    ).agg(F.count(F.lit(1)).alias("count"))


def rollup_answers(query: BucketQuery) -> bool:
    """Text and attribute filters are not in the rollup."""
    return not query.q and not query.attributes


def _floor_minute(ts: datetime) -> datetime:
    return ts.replace(second=0, microsecond=0)


def bucket_counts_from_rollup(rollup: DataFrame, logs: DataFrame, query: BucketQuery) -> DataFrame:
    """``bucket_counts`` read from the rollup, exact for any range.

    Minutes that lie wholly inside the range come from the rollup. The two ragged ends, each less
    than or equal to a minute, are counted from the logs; the lower end always is, because
    ``since`` is exclusive and a row at exactly that time shares its minute with rows that count.
    """
    if not rollup_answers(query):
        return bucket_counts(logs, query)
    first, end = _floor_minute(query.since) + MINUTE, _floor_minute(query.until)
    if first >= end:
        return bucket_counts(logs, query)

    whole = [F.col("start") >= instant(first), F.col("start") < instant(end)]
    if "dt" in rollup.columns:
        whole += day_predicates(first, end - MINUTE)
    parts = [
        where_all(rollup, whole + field_predicates(query)).select(
            "start", "service", "level", "count"
        ),
        minute_rollup(select_rows(logs, replace(query, until=first))),
    ]
    if end < query.until:
        # Exclusive bounds, as everywhere in this query: start just before the minute.
        tail = replace(query, since=end - timedelta(microseconds=1))
        parts.append(minute_rollup(select_rows(logs, tail)))
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return _ordered(
        united.groupBy(
            bucket_start(F.col("start"), query.bucket).alias("start"),
            _group(query).alias("group"),
        ).agg(F.sum("count").alias("count"))
    )
