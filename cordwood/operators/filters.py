"""Predicates of the two queries, each a plain Column that Catalyst can push to the scan."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordwood.functions.text import contains_text
from cordwood.functions.times import instant
from cordwood.plans.params import BucketQuery, Cursor, ListingQuery, Selection

TICK = timedelta(microseconds=1)


def attribute_equals(key: str, value: str) -> Column:
    """A missing key reads as the empty string."""
    return F.coalesce(F.col("attributes")[key], F.lit("")) == value


def before_cursor(cursor: Cursor) -> Column:
    """Rows after the cursor's row in newest-first order; ids break ties of time."""
    ts, at = F.col("timestamp"), instant(cursor.timestamp)
    # The first term is implied by the second; alone it is a range the scan can skip by.
    return (ts <= at) & ((ts < at) | (F.col("id") < cursor.id))


def field_predicates(selection: Selection) -> list[Column]:
    """Everything but time: equality on columns, text search, attributes."""
    found = []
    if selection.service:
        found.append(F.col("service") == selection.service)
    if selection.level:
        found.append(F.col("level") == selection.level)
    if selection.q:
        found.append(contains_text(F.col("message"), selection.q, selection.search_mode))
    found.extend(attribute_equals(key, value) for key, value in selection.attributes)
    return found


def day_predicates(first: datetime | None, last: datetime | None) -> list[Column]:
    """Bounds on the partition column for rows with first <= timestamp <= last.

    Spark does not derive these from a predicate on ``timestamp``.
    """
    found = []
    if first is not None:
        found.append(F.col("dt") >= F.lit(first.date()))
    if last is not None:
        found.append(F.col("dt") <= F.lit(last.date()))
    return found


def listing_predicates(query: ListingQuery) -> list[Column]:
    """``since`` is inclusive, ``until`` exclusive."""
    found = field_predicates(query)
    if query.since is not None:
        found.append(F.col("timestamp") >= instant(query.since))
    if query.until is not None:
        found.append(F.col("timestamp") < instant(query.until))
    if query.cursor is not None:
        found.append(before_cursor(query.cursor))
    return found


def bucket_predicates(query: BucketQuery) -> list[Column]:
    """``since`` and ``until`` are both exclusive."""
    return [
        F.col("timestamp") > instant(query.since),
        F.col("timestamp") < instant(query.until),
        *field_predicates(query),
    ]


def time_bounds(query: Selection) -> tuple[datetime | None, datetime | None]:
    """First and last instant a matching row can have."""
    first = query.since
    if isinstance(query, BucketQuery):
        first = query.since + TICK
    ends = []
    if query.until is not None:
        ends.append(query.until - TICK)
    if isinstance(query, ListingQuery) and query.cursor is not None:
        ends.append(query.cursor.timestamp)
    return first, min(ends, default=None)


def where_all(df: DataFrame, predicates: list[Column]) -> DataFrame:
    return df.where(reduce(and_, predicates)) if predicates else df


def select_rows(df: DataFrame, query: Selection) -> DataFrame:
    """The rows a query asks for; partitions are pruned where the table has days."""
    if isinstance(query, ListingQuery):
        predicates = listing_predicates(query)
    else:
        predicates = bucket_predicates(query)
    if "dt" in df.columns:
        predicates = day_predicates(*time_bounds(query)) + predicates
    return where_all(df, predicates)
