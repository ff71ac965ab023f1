"""Every registered query: a callable from (spark, folder of sample tables) to a DataFrame.

Each one reads whole tables. Maps and arrays leave as scalar columns, so that results can be
compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordwood.functions.times import bucket_start
from cordwood.operators import buckets, digests, distinct, ingest, listing, loadtest, quantiles, reconcile
from cordwood.operators.filters import time_bounds
from cordwood.plans.params import BucketQuery, Cursor, ListingQuery
from cordwood.session import configure, scratch_path
from cordwood.sources import generators, readers, sample_tables
from cordwood.sources.log_table import LogStore, LogTable, retained
from cordwood.sources.shredded import ShreddedTable, frequent_keys
from cordwood.sources.trigrams import TrigramIndex
from cordwood.streaming import buckets as stream_buckets
from cordwood.streaming import probes, slices
from cordwood.streaming.dedup import start_dedup
from cordwood.streaming.ingest import start_ingest

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(configure(spark), sf_dir)

    QUERIES[f.__name__] = run
    return f


def flat(rows: DataFrame, *keys: str) -> DataFrame:
    """Attributes as columns attr_<key>."""
    attributes = [F.col("attributes")[key].alias(f"attr_{key}") for key in keys]
    return rows.select("id", "timestamp", "level", "service", "message", *attributes)


def _list_events(spark, sf_dir, params, search_mode="wildcard") -> DataFrame:
    asked = ListingQuery.parse(params, search_mode)
    logs = sample_tables.event_logs(spark, sf_dir, asked.since, asked.until)
    return flat(listing.listing(logs, asked), "k", "user_id")


def _list_orders(spark, sf_dir, params) -> DataFrame:
    logs = sample_tables.order_logs(spark, sf_dir)
    return flat(listing.listing(logs, ListingQuery.parse(params)), "customer")


def _list_documents(spark, sf_dir, params, search_mode="wildcard") -> DataFrame:
    logs = sample_tables.document_logs(spark, sf_dir)
    return flat(listing.listing(logs, ListingQuery.parse(params, search_mode)), "lang")


# --- listings -----------------------------------------------------------------------------------


@query
def list_all_default(spark, sf_dir):
    return _list_events(spark, sf_dir, {})


@query
def list_limit(spark, sf_dir):
    return _list_events(spark, sf_dir, {"limit": "1000"})


@query
def list_since_until(spark, sf_dir):
    return _list_events(
        spark, sf_dir, {"since": "2024-01-10T06:00:00Z", "until": "2024-01-11T18:30:00.500Z"}
    )


@query
def list_since_edge(spark, sf_dir):
    """Rows exactly at ``since`` belong, rows exactly at ``until`` do not."""
    return _list_orders(
        spark,
        sf_dir,
        {"since": "1997-08-23T00:00:00Z", "until": "1997-08-25T00:00:00Z", "limit": "1000"},
    )


@query
def list_since_equals_until(spark, sf_dir):
    """A legal range that holds nothing."""
    return _list_orders(
        spark, sf_dir, {"since": "1997-08-23T00:00:00Z", "until": "1997-08-23T00:00:00Z"}
    )


@query
def list_service(spark, sf_dir):
    return _list_events(spark, sf_dir, {"service": "purchase"})


@query
def list_level(spark, sf_dir):
    return _list_events(spark, sf_dir, {"level": "error"})


@query
def list_empty_filters(spark, sf_dir):
    """An empty service or search text is no filter."""
    return _list_events(spark, sf_dir, {"service": "", "q": "", "limit": "50"})


@query
def list_q(spark, sf_dir):
    return _list_events(spark, sf_dir, {"q": "USER 1"})


@query
def list_q_wildcard(spark, sf_dir):
    return _list_events(spark, sf_dir, {"q": "u_er 1%value 2_.5"})


@query
def list_q_trigrams(spark, sf_dir):
    """A search over a stored table that opens only files whose trigrams allow a match."""
    table = LogTable(spark, scratch_path(spark, "logs"))
    table.load(sample_tables.document_logs(spark, sf_dir), "load")
    index = TrigramIndex(spark, table)
    index.cover(table.days())
    asked = ListingQuery.parse({"q": "the%OF AND", "limit": "1000"})
    return flat(listing.listing(index.scan_days(table.days(), asked.q), asked), "lang")


@query
def list_q_literal(spark, sf_dir):
    return _list_documents(spark, sf_dir, {"q": "%", "limit": "1000"}, "literal")


@query
def list_q_documents(spark, sf_dir):
    """Search through whole long texts."""
    return _list_documents(spark, sf_dir, {"q": "THE OF", "limit": "1000"})


@query
def list_attr(spark, sf_dir):
    return _list_events(spark, sf_dir, {"attr.k": "69"})


@query
def list_attr_two(spark, sf_dir):
    return _list_events(spark, sf_dir, {"attr.k": "69", "attr.user_id": "8"})


@query
def list_attr_missing_empty(spark, sf_dir):
    """An empty attribute value is a filter, and a missing key reads as empty."""
    return _list_events(spark, sf_dir, {"attr.nowhere": ""})


@query
def list_combined(spark, sf_dir):
    return _list_events(
        spark,
        sf_dir,
        {
            "service": "click",
            "level": "warn",
            "since": "2024-01-05T00:00:00Z",
            "until": "2024-01-25T00:00:00Z",
            "q": "value 4",
            "limit": "200",
        },
    )


@query
def list_page2_cursor(spark, sf_dir):
    """The page after the first, over times that many rows share."""
    logs = sample_tables.order_logs(spark, sf_dir)
    asked = ListingQuery.parse({"limit": "250"})
    first = listing.page(logs, asked)
    if first.next_cursor is None:
        return flat(listing.listing(logs, asked).limit(0), "customer")
    following = asked.after(Cursor.decode(first.next_cursor))
    return flat(listing.listing(logs, following), "customer")


@query
def list_next_cursor(spark, sf_dir):
    logs = sample_tables.order_logs(spark, sf_dir)
    return listing.next_page(logs, ListingQuery.parse({"limit": "250"}))


@query
def page_walk(spark, sf_dir):
    return listing.pages(sample_tables.event_logs(spark, sf_dir), 100)


@query
def page_walk_ties(spark, sf_dir):
    return listing.pages(sample_tables.order_logs(spark, sf_dir), 250)


# --- buckets ------------------------------------------------------------------------------------


def _count_events(spark, sf_dir, params) -> DataFrame:
    asked = BucketQuery.parse(params)
    logs = sample_tables.event_logs(spark, sf_dir, asked.since, asked.until)
    return buckets.bucket_counts(logs, asked)


ALL_EVENTS = {"since": "2023-12-31T00:00:00Z", "until": "2024-02-01T00:00:00Z"}
ALL_LINES = {"since": "1990-01-01T00:00:00Z", "until": "2005-01-01T00:00:00Z"}


@query
def agg_1m(spark, sf_dir):
    return _count_events(spark, sf_dir, {**ALL_EVENTS, "bucket": "1m"})


@query
def agg_5m_service(spark, sf_dir):
    return _count_events(spark, sf_dir, {**ALL_EVENTS, "bucket": "5m", "group_by": "service"})


@query
def agg_1h_service(spark, sf_dir):
    return _count_events(spark, sf_dir, {**ALL_EVENTS, "bucket": "1h", "group_by": "service"})


@query
def agg_1h_level(spark, sf_dir):
    return _count_events(spark, sf_dir, {**ALL_EVENTS, "bucket": "1h", "group_by": "level"})


@query
def agg_1d(spark, sf_dir):
    return _count_events(spark, sf_dir, {**ALL_EVENTS, "bucket": "1d"})


@query
def agg_since_edge(spark, sf_dir):
    """Rows exactly at ``since`` do not count here."""
    asked = BucketQuery.parse(
        {"since": "1997-08-23T00:00:00Z", "until": "1997-08-30T00:00:00Z", "bucket": "1d"}
    )
    return buckets.bucket_counts(sample_tables.order_logs(spark, sf_dir), asked)


@query
def agg_filtered(spark, sf_dir):
    return _count_events(
        spark,
        sf_dir,
        {
            "since": "2024-01-03T00:00:00Z",
            "until": "2024-01-28T12:34:56.789Z",
            "bucket": "5m",
            "group_by": "service",
            "level": "error",
            "q": "user 1",
        },
    )


@query
def agg_attr(spark, sf_dir):
    return _count_events(
        spark, sf_dir, {**ALL_EVENTS, "bucket": "1d", "group_by": "level", "attr.k": "69"}
    )


@query
def agg_lines_1d_level(spark, sf_dir):
    asked = BucketQuery.parse({**ALL_LINES, "bucket": "1d", "group_by": "level"})
    return buckets.bucket_counts(sample_tables.line_logs(spark, sf_dir), asked)


@query
def agg_total(spark, sf_dir):
    return buckets.bucket_total(_count_events(spark, sf_dir, {**ALL_EVENTS, "bucket": "1d"}))


@query
def agg_group_totals(spark, sf_dir):
    return buckets.group_totals(
        _count_events(spark, sf_dir, {**ALL_EVENTS, "bucket": "1h", "group_by": "service"})
    )


ROLLUP_RANGE = {
    "since": "2024-01-02T03:04:05.678Z",
    "until": "2024-01-27T08:09:10.111Z",
    "bucket": "5m",
    "group_by": "level",
    "service": "view",
}


@query
def agg_from_rollup(spark, sf_dir):
    asked = BucketQuery.parse(ROLLUP_RANGE)
    logs = sample_tables.event_logs(spark, sf_dir, asked.since, asked.until)
    rollup = buckets.minute_rollup(sample_tables.event_logs(spark, sf_dir))
    return buckets.bucket_counts_from_rollup(rollup, logs, asked)


# --- ingest -------------------------------------------------------------------------------------


def _validated(spark, sf_dir) -> DataFrame:
    return ingest.validate(sample_tables.event_envelopes(spark, sf_dir))


ATTRIBUTE_KEYS = ("user_id", "value", "type", "big")


@query
def ingest_accepted(spark, sf_dir):
    return flat(ingest.accepted(_validated(spark, sf_dir)), *ATTRIBUTE_KEYS)


@query
def ingest_rejected(spark, sf_dir):
    return ingest.rejected(_validated(spark, sf_dir)).drop("received_at")


def _flat_receipts(receipts: DataFrame) -> DataFrame:
    reasons = F.transform(
        "rejected", lambda r: F.concat(r["index"].cast("string"), F.lit("="), r["reason"])
    )
    return receipts.select(
        "request_id",
        "status",
        "http_status",
        "accepted",
        F.size("rejected").alias("rejected"),
        F.array_join(reasons, "; ").alias("reasons"),
    )


@query
def ingest_receipts(spark, sf_dir):
    return _flat_receipts(ingest.receipts(_validated(spark, sf_dir)))


@query
def ingest_status(spark, sf_dir):
    """Bodies of every shape, well-formed or not."""
    bodies = sample_tables.order_envelopes(spark, sf_dir)
    return _flat_receipts(ingest.receipts(ingest.validate(bodies)))


@query
def ingest_lenient(spark, sf_dir):
    """An empty service passes when only the types are checked."""
    bodies = sample_tables.event_envelopes(spark, sf_dir)
    return ingest.rejected(ingest.validate(bodies, require_non_empty=False)).select(
        "request_id", "index", "reason"
    )


@query
def ingest_normalised(spark, sf_dir):
    """Attribute texts, counted: the stored form of numbers, booleans and strings."""
    rows = ingest.accepted(_validated(spark, sf_dir))
    return (
        rows.select(F.explode("attributes").alias("key", "value"))
        .groupBy("key", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@query
def ingest_totals(spark, sf_dir):
    return ingest.ingest_summary(ingest.receipts(_validated(spark, sf_dir)))


@query
def id_assignment(spark, sf_dir):
    return ingest.accepted(_validated(spark, sf_dir)).select("request_id", "id", "timestamp")


@query
def dedup_by_id(spark, sf_dir):
    return flat(ingest.drop_redelivered(sample_tables.visible_logs(spark, sf_dir)), "k", "user_id")


# --- tables -------------------------------------------------------------------------------------


@query
def bulk_load_json(spark, sf_dir):
    """Write JSON lines, load them without validation, read the table back."""
    lines, root = scratch_path(spark, "lines"), scratch_path(spark, "bulk")
    logs = sample_tables.event_logs(spark, sf_dir)
    logs.write.option("timestampNTZFormat", readers.BULK_TIME).json(lines)
    table = LogTable(spark, root)
    table.load(readers.read_bulk(spark, lines), "bulk")
    return flat(table.read(), "k", "user_id")


@query
def bulk_load_default_id(spark, sf_dir):
    """Rows that come without an id get one each."""
    lines = scratch_path(spark, "lines")
    logs = sample_tables.event_logs(spark, sf_dir).drop("id")
    logs.write.option("timestampNTZFormat", readers.BULK_TIME).json(lines)
    return reconcile.distinct_ids(readers.read_bulk(spark, lines))


def _stored_events(spark, sf_dir) -> LogTable:
    table = LogTable(spark, scratch_path(spark, "logs"))
    table.load(sample_tables.event_logs(spark, sf_dir), "load")
    return table


@query
def table_listing(spark, sf_dir):
    """A listing over the stored table, pruned to the days it asks for."""
    asked = ListingQuery.parse(
        {"since": "2024-01-12T00:00:00Z", "until": "2024-01-14T12:00:00Z", "level": "error"}
    )
    days = _stored_events(spark, sf_dir).scan(*time_bounds(asked))
    return flat(listing.listing(days, asked), "k", "user_id")


@query
def table_buckets(spark, sf_dir):
    asked = BucketQuery.parse(
        {
            "since": "2024-01-12T00:00:00Z",
            "until": "2024-01-14T12:00:00Z",
            "bucket": "1h",
            "group_by": "service",
        }
    )
    return buckets.bucket_counts(_stored_events(spark, sf_dir).scan(*time_bounds(asked)), asked)


RETENTION_NOW = datetime(2024, 2, 10, 12)


@query
def retention_30d(spark, sf_dir):
    return flat(
        retained(sample_tables.event_logs(spark, sf_dir), RETENTION_NOW), "k", "user_id"
    )


@query
def retention_days_dropped(spark, sf_dir):
    """What is left after whole days past the limit are deleted."""
    table = _stored_events(spark, sf_dir)
    table.expire(RETENTION_NOW)
    return table.read().groupBy("dt").agg(F.count(F.lit(1)).alias("rows"))


# --- reconciliation -----------------------------------------------------------------------------


def _both_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return sample_tables.event_logs(spark, sf_dir), sample_tables.visible_logs(spark, sf_dir)


@query
def reconcile_counts(spark, sf_dir):
    run = sample_tables.run_of(F.col("timestamp"))
    accepted, visible = (side.withColumn("run_id", run) for side in _both_sides(spark, sf_dir))
    return reconcile.count_check(accepted, visible, ["run_id"])


@query
def reconcile_missing(spark, sf_dir):
    return reconcile.missing_rows(reconcile.copy_counts(*_both_sides(spark, sf_dir)))


@query
def reconcile_duplicates(spark, sf_dir):
    return reconcile.surplus_rows(reconcile.copy_counts(*_both_sides(spark, sf_dir)))


@query
def reconcile_set(spark, sf_dir):
    return reconcile.set_check(reconcile.copy_counts(*_both_sides(spark, sf_dir)))


@query
def distinct_ids(spark, sf_dir):
    return reconcile.distinct_ids(sample_tables.visible_logs(spark, sf_dir))


@query
def read_after_write(spark, sf_dir):
    return reconcile.read_after_write(
        sample_tables.probes(spark, sf_dir),
        sample_tables.visible_logs(spark, sf_dir),
        ["run_id"],
        service="signup",
    )


@query
def reconcile_digests(spark, sf_dir):
    """Ids that were sent and are not there once, found from digests of both sides."""
    sent, visible = sample_tables.event_logs(spark, sf_dir), sample_tables.visible_logs(spark, sf_dir)
    sides = []
    for name, logs in (("sent", sent), ("visible", visible)):
        table = digests.digest_table(spark, scratch_path(spark, name))
        table.write(digests.digests(logs), "all")
        sides.append(table.read())
    return digests.differences(sent, visible, digests.differing_leaves(*sides))


@query
def probe_stream(spark, sf_dir):
    """Probes answered or given up after 30 seconds by a stream of logs that come with a delay."""
    signups = sample_tables.event_logs(spark, sf_dir).where(F.col("service") == "signup")
    delay = F.make_dt_interval(secs=(F.col("attributes")["user_id"].cast("long") % 45).cast("decimal(18,6)"))
    visible = sample_tables.visible_logs(spark, sf_dir).where(F.col("service") == "signup")
    sent = signups.select(
        F.col("id").alias("probe_id"), sample_tables.run_of(F.col("timestamp")).alias("run_id"), "message",
        F.col("timestamp").alias("sent_at"),
    )
    seen = visible.select("message", (F.col("timestamp") + delay).alias("seen_at"))
    end = [("end", "end", "end", datetime(2030, 1, 1))]
    folders = {}
    for name, rows, time, last in (
        ("sent", sent, "sent_at", spark.createDataFrame(end, sent.schema)),
        ("seen", seen, "seen_at", spark.createDataFrame([row[2:] for row in end], seen.schema)),
    ):
        folders[name] = scratch_path(spark, name)
        # Four spans of time, one after the other, and a row that ends the streams.
        days = [datetime(1970, 1, 1), *(datetime(2024, 1, day) for day in (9, 17, 25)), datetime(2029, 1, 1)]
        parts = [rows.where((F.col(time) >= F.lit(a)) & (F.col(time) < F.lit(b))) for a, b in zip(days, days[1:])]
        for part in (*parts, last):
            part.coalesce(1).write.mode("append").parquet(folders[name])
    arriving = {
        name: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folders[name])
        for name, rows in (("sent", sent), ("seen", seen))
    }
    table = probes.outcome_table(spark, scratch_path(spark, "outcomes"))
    outcomes = probes.probe_outcomes(arriving["sent"], arriving["seen"], "30 seconds", "1 minute")
    probes.start_outcomes(outcomes, table, scratch_path(spark, "progress")).awaitTermination()
    rates = probes.answered_rates(table.read().where("run_id <> 'end'"))
    return rates.select("run_id", "probes_total", "probes_passed", "read_after_write_rate")


FIRST_DAYS = (datetime(2024, 1, 3), datetime(2024, 1, 14))
SECOND_DAYS = (datetime(2024, 1, 10), datetime(2024, 1, 25))


@query
def distinct_ranges(spark, sf_dir):
    """Distinct users of two overlapping ranges of days from stored sketches, beside the exact numbers."""
    events = sample_tables.table(spark, sf_dir, "events").select(
        F.col("ts").alias("timestamp"), F.col("event_type").alias("service"), "user_id"
    )
    table = distinct.distinct_table(spark, scratch_path(spark, "sketches"), ["service"])
    for number in range(2):
        part = events.where(F.pmod(F.xxhash64("timestamp"), F.lit(2)) == number)
        table.write(distinct.distinct_sketches(part, ["service"], "user_id"), f"part-{number}")

    def within(column: str, days: tuple[datetime, datetime]):
        first, last = (F.lit(day).cast("timestamp_ntz") for day in days)
        return (F.col(column) >= first) & (F.col(column) < last)

    ranges = {column: [within(column, days) for days in (FIRST_DAYS, SECOND_DAYS)] for column in ("start", "timestamp")}
    estimated = distinct.compared_ranges(table.read(), ["service"], *ranges["start"])
    exact = distinct.exact_ranges(events, ["service"], "user_id", *ranges["timestamp"])
    numbers = ["in_first", "in_second", "in_either", "in_both", "only_first"]
    near = [F.abs(F.col(f"e.{name}") - F.col(f"x.{name}")) <= F.col("e.bound") for name in numbers]
    return exact.alias("x").join(estimated.alias("e"), "service").select(
        "service", *(f"x.{name}" for name in numbers), reduce(and_, near).alias("within_bound")
    )


@query
def list_attr_shredded(spark, sf_dir):
    """Rows with one value of an attribute that is frequent enough to be a column."""
    logs = sample_tables.event_logs(spark, sf_dir)
    table = ShreddedTable(spark, scratch_path(spark, "shredded"), frequent_keys(logs))
    table.write(logs, "load")
    asked = ListingQuery.parse({"attr.k": "69"})
    return flat(listing.listing(table.scan({"k": "69"}), asked), "k", "user_id")


# --- load tests ---------------------------------------------------------------------------------


def _samples(spark, sf_dir) -> DataFrame:
    return sample_tables.request_samples(spark, sf_dir)


@query
def loadtest_rollup(spark, sf_dir):
    return loadtest.request_rollup(_samples(spark, sf_dir)).drop("exit_code", "recovered")


@query
def loadtest_p95(spark, sf_dir):
    return loadtest.latency_p95(_samples(spark, sf_dir))


@query
def loadtest_p95_phases(spark, sf_dir):
    return loadtest.latency_p95(_samples(spark, sf_dir), loadtest.PHASE_KEYS)


@query
def loadtest_throughput(spark, sf_dir):
    rollup = loadtest.request_rollup(_samples(spark, sf_dir))
    return loadtest.throughput(rollup).drop("latency_limit", "exit_code", "recovered")


@query
def loadtest_limitation(spark, sf_dir):
    return loadtest.phase_results(_samples(spark, sf_dir))


@query
def loadtest_status(spark, sf_dir):
    return loadtest.scenario_results(_samples(spark, sf_dir)).select(
        *loadtest.SCENARIO_KEYS, "limited_by", "threshold_passed", "status"
    )


@query
def loadtest_breakpoint(spark, sf_dir):
    return loadtest.breakpoints(loadtest.phase_results(_samples(spark, sf_dir)))


@query
def weighted_rate(spark, sf_dir):
    return loadtest.achieved_rate(loadtest.phase_results(_samples(spark, sf_dir)))


@query
def loadtest_consistency(spark, sf_dir):
    """Accepted by request samples against what their log rows show."""
    samples = _samples(spark, sf_dir)
    keys = list(loadtest.SCENARIO_KEYS)
    served = samples.where((F.col("type") == "ingest") & (F.col("status") == 200))
    # Slow requests were stored for the most part only.
    stored = F.when(F.col("duration_ms") > 400, 60).otherwise(F.col("accepted"))
    visible = served.groupBy(*keys).agg(F.sum(stored).alias("visible_records"))
    ok = F.count_if(F.col("duration_ms") <= 300)
    reads = (
        samples.groupBy(*keys)
        .agg((ok / F.count(F.lit(1))).alias("rate"))
        .select(*keys, F.round("rate", 4).alias("read_after_write_rate"))
    )
    return loadtest.consistency(loadtest.throughput(loadtest.request_rollup(samples)), visible, reads)


@query
def loadtest_outcomes(spark, sf_dir):
    """Eight runs that end in every way: who limited them, whether they held, their status."""
    results = loadtest.scenario_results(sample_tables.run_samples(spark, sf_dir))
    return results.select(
        *loadtest.SCENARIO_KEYS, "error_rate", "limited_by", "threshold_passed", "status"
    )


@query
def loadtest_outcome_phases(spark, sf_dir):
    return loadtest.phase_results(sample_tables.run_samples(spark, sf_dir))


@query
def loadtest_outcome_breakpoints(spark, sf_dir):
    return loadtest.breakpoints(loadtest.phase_results(sample_tables.run_samples(spark, sf_dir)))


@query
def loadtest_visible_consistency(spark, sf_dir):
    """What was sent against what can be read in the logs, by quarter of an hour and scenario."""
    keys = list(loadtest.SCENARIO_KEYS)
    day = F.dayofmonth("timestamp")
    scenario = (
        F.when(day <= 7, "load").when(day <= 14, "stress").when(day <= 21, "spike").otherwise("breakpoint")
    )

    def keyed(logs):
        run = sample_tables.quarter_hour(F.col("timestamp"))
        return logs.withColumns({"run_id": run, "scenario": scenario})

    visible_logs = sample_tables.visible_logs(spark, sf_dir)
    sent = keyed(sample_tables.event_logs(spark, sf_dir))
    accepted = sent.groupBy(*keys).agg(F.count(F.lit(1)).alias("accepted_records"))
    visible = keyed(visible_logs).groupBy(*keys).agg(F.count(F.lit(1)).alias("visible_records"))
    probes = sent.where(F.col("service") == "signup").select(*keys, "message")
    reads = reconcile.read_after_write(probes, visible_logs, keys, service="signup")
    return loadtest.consistency(accepted, visible, reads.select(*keys, "read_after_write_rate"))


RELOAD_FROM = "2024-01-15 00:00:00"


@query
def reload_replaces_batch(spark, sf_dir):
    """A batch loaded a second time with only the later half of its rows."""
    events = sample_tables.event_logs(spark, sf_dir)
    store = LogStore(spark, scratch_path(spark, "store"))
    store.load(events, "load")
    store.load(events.where(F.col("timestamp") >= F.lit(RELOAD_FROM).cast("timestamp_ntz")), "load")
    return flat(store.logs.read(), "k", "user_id")


QUANTILE_RANGE = "start >= timestamp_ntz '2024-01-05 00:00:00' AND start < timestamp_ntz '2024-01-20 12:00:00'"


@query
def quantile_range(spark, sf_dir):
    """Exact 95th percentiles of a range of time, from stored sketches that were merged."""
    events = sample_tables.table(spark, sf_dir, "events").select(
        F.col("ts").alias("timestamp"), F.col("event_type").alias("service"), "value"
    )
    table = quantiles.quantile_table(spark, scratch_path(spark, "sketches"), ["service"])
    for number in range(3):
        part = events.where(F.pmod(F.xxhash64("timestamp"), F.lit(3)) == number)
        table.write(quantiles.quantile_sketches(part, ["service"], "value"), f"part-{number}")
    table.merge(date(2024, 1, 10))
    rows = events.withColumn("start", F.col("timestamp")).where(QUANTILE_RANGE)
    found = quantiles.exact_quantile(rows, ["service"], "value", 0.95, table.read().where(QUANTILE_RANGE))
    return found.select("service", F.round("quantile", 6).alias("p95"))


# --- generators ---------------------------------------------------------------------------------

SEED_NOW = datetime(2024, 2, 1)


def _rows(spark, sf_dir) -> DataFrame:
    """One generated log per event, numbered like it."""
    return sample_tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("row"))


SEEDED_KEYS = ("user_id", "region", "duration_ms", "cached", "version")


@query
def seed_generate(spark, sf_dir):
    return flat(generators.seeded_logs(_rows(spark, sf_dir), SEED_NOW), *SEEDED_KEYS)


@query
def seed_level_mix(spark, sf_dir):
    logs = generators.seeded_logs(_rows(spark, sf_dir), SEED_NOW)
    return logs.groupBy("service", "level").agg(F.count(F.lit(1)).alias("rows"))


@query
def seed_ingest(spark, sf_dir):
    """Generated requests through validation: attempted, accepted, rejected, and rows by day."""
    logs = generators.seeded_logs(_rows(spark, sf_dir), SEED_NOW)
    bodies = generators.as_envelopes(logs, SEED_NOW, generators.SEED_BATCH)
    rows = ingest.accepted(ingest.validate(bodies))
    return rows.groupBy(bucket_start(F.col("timestamp"), "1d").alias("start")).agg(
        F.count(F.lit(1)).alias("count")
    )


@query
def seed_uniform(spark, sf_dir):
    logs = generators.uniform_logs(_rows(spark, sf_dir))
    return flat(logs, "user_id", "region", "retries")


@query
def seed_load_shape(spark, sf_dir):
    logs = generators.load_logs(_rows(spark, sf_dir), SEED_NOW, "run-1", workers=20)
    return flat(logs, "user_id", "region", "retries", "run_id")


# --- streams ------------------------------------------------------------------------------------


def _streamed_store(spark, sf_dir) -> LogStore:
    """Event requests written as files, then taken in by a stream that stops when all are read."""
    arrivals, root = scratch_path(spark, "arrivals"), scratch_path(spark, "store")
    sample_tables.event_envelopes(spark, sf_dir).repartition(6).write.json(arrivals)
    store = LogStore(spark, root)
    arriving = readers.stream_envelopes(spark, arrivals, max_files=1)
    running = start_ingest(arriving, store, scratch_path(spark, "progress"))
    running.awaitTermination()
    return store


@query
def stream_ingest(spark, sf_dir):
    return flat(_streamed_store(spark, sf_dir).logs.read(), *ATTRIBUTE_KEYS)


@query
def stream_ingest_rejects(spark, sf_dir):
    return _streamed_store(spark, sf_dir).rejects.read().select("request_id", "index", "reason")


@query
def stream_ingest_receipts(spark, sf_dir):
    return _flat_receipts(_streamed_store(spark, sf_dir).receipts.read())


@query
def stream_rollup(spark, sf_dir):
    """Buckets answered from the rollup the stream keeps."""
    store = _streamed_store(spark, sf_dir)
    return buckets.bucket_counts_from_rollup(
        store.rollup.read(), store.logs.read(), BucketQuery.parse(ROLLUP_RANGE)
    )


@query
def stream_slices_ingest(spark, sf_dir):
    """The same requests, cut into slices of at most 15,000 entries and taken in one at a time."""
    arrivals, cut = scratch_path(spark, "arrivals"), scratch_path(spark, "slices")
    sample_tables.event_envelopes(spark, sf_dir).write.json(arrivals)
    arriving = readers.stream_envelopes(spark, arrivals)
    slices.start_slicing(arriving, cut, scratch_path(spark, "cutting")).awaitTermination()
    store = LogStore(spark, scratch_path(spark, "store"))
    taken = slices.stream_slices(spark, cut)
    start_ingest(taken, store, scratch_path(spark, "progress"), bounded=True).awaitTermination()
    return flat(store.logs.read(), *ATTRIBUTE_KEYS)


def _merged_store(spark, sf_dir) -> LogStore:
    """Events stored in four micro-batches, all but the last merged."""
    store = LogStore(spark, scratch_path(spark, "store"))
    for number in range(4):
        rows = sample_tables.event_logs(spark, sf_dir).where(F.crc32(F.col("id").cast("binary")) % 4 == number)
        store.logs.append(rows, f"micro-{number}")
        store.rollup.write(buckets.minute_rollup(rows), f"micro-{number}")
    store.merge(MERGE_BEFORE, {"micro-3"})
    store.sweep(datetime.now() + timedelta(days=2))
    return store


MERGE_BEFORE = date(2024, 1, 20)


@query
def merge_days(spark, sf_dir):
    """All rows after the small batches of closed days were merged and deleted."""
    return flat(_merged_store(spark, sf_dir).logs.read(), "k", "user_id")


@query
def merge_rollup(spark, sf_dir):
    """Five-minute counts from a rollup whose closed days were merged."""
    store = _merged_store(spark, sf_dir)
    return buckets.bucket_counts_from_rollup(
        store.rollup.read(), store.logs.read(), BucketQuery.parse(ROLLUP_RANGE)
    )


@query
def stream_bucket_counts(spark, sf_dir):
    schema = sample_tables.table(spark, sf_dir, "events").schema
    # Six micro-batches, each over the whole time span.
    files = scratch_path(spark, "files")
    sample_tables.table(spark, sf_dir, "events").repartition(6, "event_id").write.parquet(files)
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)
    logs = arriving.select(
        *[column.alias(name) for name, column in sample_tables.event_columns().items()]
    )
    counts = stream_buckets.running_counts(logs, "1h", "service")
    table = stream_buckets.counts_table(spark, scratch_path(spark, "counts"))
    progress = scratch_path(spark, "progress")
    stream_buckets.start_counts(counts, table, progress, merge_every=3).awaitTermination()
    return stream_buckets.current_counts(table.read())


@query
def stream_dedup(spark, sf_dir):
    """Rows of which some arrive twice, in six micro-batches out of the order of time."""
    arrivals = scratch_path(spark, "arrivals")
    sample_tables.visible_logs(spark, sf_dir).repartition(6).write.parquet(arrivals)
    schema = spark.read.parquet(arrivals).schema
    table = LogTable(spark, scratch_path(spark, "distinct"))
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
    start_dedup(arriving, table, scratch_path(spark, "progress")).awaitTermination()
    return flat(table.read(), "k", "user_id")
