"""Newest-first listing with keyset paging."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from cordwood.functions.text import cursor_text
from cordwood.functions.times import bucket_start, format_iso
from cordwood.operators.filters import select_rows, time_bounds
from cordwood.plans.params import Cursor, ListingQuery
from cordwood.schema import LOG_COLUMNS
from cordwood.session import plan_bytes, shared_dir
from cordwood.sources.log_table import LogTable, within_days


def newest_first() -> list[Column]:
    return [F.col("timestamp").desc(), F.col("id").desc()]


# Plans that read less than this, about one task's input, take the newest rows in one step.
DIRECT_BYTES = 128 << 20
LANES = 512


def _newest_candidates(rows: DataFrame, count: int) -> DataFrame:
    """A small superset of the newest ``count`` rows, for input read by very many tasks.

    Rows are counted by minute, which reads the time and the filtered columns only. The minutes
    that are needed to reach ``count`` bound the second read from below, and the bound reaches the
    scan. Should one minute hold a large part of all rows, many tasks will still offer ``count``
    rows each; they are thinned by lanes first, so that the last step merges LANES lists and not
    one per task.
    """
    minutes = rows.groupBy(bucket_start(F.col("timestamp"), "1m").alias("start")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    # Each minute has a row at least, so the newest ``count`` of them hold the page.
    minutes = minutes.orderBy(F.desc("start")).limit(count)
    newer = F.sum("rows").over(
        Window.orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, -1)
    )
    floor = (
        minutes.select("start", F.coalesce(newer, F.lit(0)).alias("newer"))
        .where(F.col("newer") < count)
        .agg(F.min("start"))
    )
    lane = Window.partitionBy("lane").orderBy(*newest_first())
    return (
        rows.where(F.col("timestamp") >= floor.scalar())
        .withColumn("lane", F.spark_partition_id() % LANES)
        .withColumn("place", F.row_number().over(lane))
        .where(F.col("place") <= count)
        .drop("lane", "place")
    )


def top_rows(
    df: DataFrame, query: ListingQuery, count: int, direct_bytes: int = DIRECT_BYTES
) -> DataFrame:
    """The newest ``count`` matching rows: every task keeps that many, no full sort."""
    rows = select_rows(df, query).select(*LOG_COLUMNS)
    if count and plan_bytes(rows) > direct_bytes:
        rows = _newest_candidates(rows, count)
    return rows.orderBy(*newest_first()).limit(count)


def with_iso_time(rows: DataFrame) -> DataFrame:
    """The listing's output columns; the time becomes text only after filter and sort."""
    return rows.withColumn("timestamp", format_iso(F.col("timestamp")))


def listing(df: DataFrame, query: ListingQuery) -> DataFrame:
    """One page as a DataFrame, without the cursor."""
    return with_iso_time(top_rows(df, query, query.limit))


def next_page(df: DataFrame, query: ListingQuery) -> DataFrame:
    """One row that says whether the page has a successor, and the cursor leading to it."""
    # At most limit + 1 rows arrive here.
    fetched = F.sort_array(
        F.collect_list(F.struct(F.col("timestamp"), F.col("id"))), asc=False
    )
    last = F.col("fetched")[query.limit - 1]
    has_next = F.size("fetched") > query.limit
    return (
        top_rows(df, query, query.limit + 1)
        .agg(fetched.alias("fetched"))
        .select(
            F.least(F.size("fetched"), F.lit(query.limit)).alias("rows"),
            has_next.alias("has_next"),
            F.when(has_next, cursor_text(format_iso(last["timestamp"]), last["id"])).alias(
                "next_cursor"
            ),
        )
    )


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    next_cursor: str | None


def page(source: DataFrame | LogTable, query: ListingQuery) -> Page:
    """Run one listing request: fetch one row more than asked, keep the rest, set the cursor."""
    wanted = query.limit + 1
    if isinstance(source, LogTable):
        fetched = _newest_by_day(source, query, wanted)
    else:
        fetched = _collected(top_rows(source, query, wanted))
    kept = fetched[: query.limit]
    if len(fetched) <= query.limit:
        return Page(kept, None)
    return Page(kept, Cursor(kept[-1]["timestamp"], kept[-1]["id"]).encode())


def _collected(rows: DataFrame) -> list[Row]:
    """Rows of a page; the time of a year that Python has no date for stays ISO text."""
    known = F.when(F.year("timestamp").between(1, 9999), F.col("timestamp"))
    named = Row(*rows.columns)
    timed = rows.withColumns({"_text": format_iso(F.col("timestamp")), "timestamp": known})
    return [
        named(*(row["_text"] if name == "timestamp" and row[name] is None else row[name] for name in rows.columns))
        for row in timed.collect()
    ]


def _newest_by_day(table: LogTable, query: ListingQuery, wanted: int) -> list[Row]:
    """Read the newest days first and stop once the page is full.

    Every row of a day is newer than every row of an earlier day, so the days can be read in
    spans that double in length: a page off the end of a year of logs reads one day, and a filter
    that matches nothing costs a handful of jobs rather than one per day.
    """
    first, last = time_bounds(query)
    days = sorted(within_days(table.days(), first, last), reverse=True)
    found: list[Row] = []
    taken, span = 0, 1
    while taken < len(days) and len(found) < wanted:
        part = _scanned(table, query, days[taken : taken + span])
        found += _collected(top_rows(part, query, wanted - len(found)))
        taken, span = taken + span, span * 2
    return found


def _scanned(table: LogTable, query: ListingQuery, days: list[str]) -> DataFrame:
    """Rows of some days; a search skips files whose signature says that they hold no match."""
    if table.trigrams is None or not query.q:
        return table.scan_days(days)
    return table.trigrams.scan_days(days, query.q, query.search_mode)


def walk(source: DataFrame | LogTable, query: ListingQuery) -> Iterator[Page]:
    """Follow cursors until there is none, one request per page."""
    while True:
        current = page(source, query)
        yield current
        if current.next_cursor is None:
            return
        query = query.after(Cursor.decode(current.next_cursor))


def _positions(df: DataFrame) -> DataFrame:
    """All keys with their position in newest-first order, from 0, and the number of rows.

    A window over the whole table would put every row into one task. Instead the sort spreads
    rows by range of (timestamp, id), which also splits a crowd of equal times; a row's place in
    its partition plus the sizes of the partitions before it is its position. The sorted keys are
    checkpointed so that both uses see the same partitions.
    """
    shared_dir(df.sparkSession)
    # The id packs the partition number above 33 bits of row number.
    keys = (
        df.select("timestamp", "id")
        .orderBy(*newest_first())
        .withColumn("place", F.monotonically_increasing_id())
        .select(
            "timestamp",
            "id",
            F.shiftright("place", 33).alias("part"),
            F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"),
        )
        .checkpoint()
    )
    # One row per partition of the sort, so this table is as small as the plan is wide: it may
    # pass through one task and be broadcast.
    by_part = Window.orderBy("part")
    before = F.sum("size").over(by_part.rowsBetween(Window.unboundedPreceding, -1))
    every = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = (
        keys.groupBy("part")
        .agg(F.count(F.lit(1)).alias("size"))
        .select(
            "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(every).alias("total")
        )
    )
    return keys.join(F.broadcast(earlier), "part").select(
        "timestamp", "id", (F.col("before") + F.col("nth")).alias("position"), "total"
    )


def numbered(df: DataFrame) -> DataFrame:
    """All rows' keys with their position in newest-first order, from 0."""
    return _positions(df).drop("total")


def pages(df: DataFrame, limit: int) -> DataFrame:
    """What a complete cursor walk would visit: one row per page with its edges."""
    position, total = F.col("position"), F.col("total")
    page, place = F.floor(position / limit), position % limit
    is_first, is_last = place == 0, (place == limit - 1) | (position == total - 1)
    # Two rows of every page tell all about it; the others are not shuffled.
    edges = _positions(df).where(is_first | is_last)

    def of(edge: Column, value: Column) -> Column:
        return F.max(F.when(edge, value))

    iso = format_iso(F.col("timestamp"))
    return edges.groupBy(page.alias("page")).agg(
        F.least(F.lit(limit), F.max(total) - F.min(position)).cast("bigint").alias("rows"),
        of(is_first, iso).alias("first_timestamp"),
        of(is_first, F.col("id")).alias("first_id"),
        of(is_last, iso).alias("last_timestamp"),
        of(is_last, F.col("id")).alias("last_id"),
    )
