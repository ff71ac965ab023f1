"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the sample tables (default sf0.1), BENCH_CPUS the local threads (default 8).
The log table is loaded once, which is timed, and queried as stored; the remaining queries run as
registered. Every query runs once to warm up and then three times; its median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordwood.operators import buckets, ingest, listing
from cordwood.operators.filters import time_bounds
from cordwood.plans.params import BucketQuery, ListingQuery
from cordwood.plans.registry import QUERIES
from cordwood.schema import ENVELOPE_SCHEMA
from cordwood.session import build_session, scratch_path
from cordwood.sources import sample_tables
from cordwood.sources.log_table import LogStore, LogTable
from cordwood.streaming import ingest as stream_ingest

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 3

MONTH = {"since": "2023-12-31T00:00:00Z", "until": "2024-01-30T00:00:00Z"}

REGISTERED = (
    "agg_5m_service",
    "agg_lines_1d_level",
    "list_q_documents",
    "ingest_receipts",
    "dedup_by_id",
    "reconcile_counts",
    "reconcile_set",
    "read_after_write",
    "page_walk",
    "loadtest_p95",
    "loadtest_limitation",
    "seed_level_mix",
    "stream_ingest",
)


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    events = sample_tables.event_logs(spark, SF_DIR)
    rows = events.count()

    table = LogTable(spark, scratch_path(spark, "logs"))
    table.load(events, "load")
    arrivals = scratch_path(spark, "arrivals")
    sample_tables.event_envelopes(spark, SF_DIR).repartition(int(CPUS)).write.parquet(arrivals)
    envelopes = spark.read.schema(ENVELOPE_SCHEMA).parquet(arrivals)

    hourly = BucketQuery.parse({**MONTH, "bucket": "1h", "group_by": "service"})
    page = ListingQuery.parse({**MONTH, "limit": "50"})
    found = ListingQuery.parse({**MONTH, "limit": "50", "q": "user 1", "level": "error"})
    batches = iter(range(1000))

    def write_store() -> None:
        store = LogStore(spark, scratch_path(spark, "store"))
        stream_ingest.write_batch(envelopes, store, f"bench-{next(batches)}")

    runs = {
        "bulk_load": lambda: LogTable(spark, scratch_path(spark, "logs")).load(events, "load"),
        "validate": lambda: consume(ingest.accepted(ingest.validate(envelopes))),
        "ingest_batch": write_store,
        "listing_30d": lambda: listing.page(table, page),
        "listing_30d_filtered": lambda: listing.page(table, found),
        "aggregate_30d_1h_service": lambda: buckets.bucket_counts(
            table.scan(*time_bounds(hourly)), hourly
        ).collect(),
        "rollup_30d": lambda: buckets.minute_rollup(table.read()).agg(F.sum("count")).collect(),
    }
    for name in REGISTERED:
        runs[name] = lambda query=QUERIES[name]: consume(query(spark, SF_DIR))

    seconds = {}
    for name, run in runs.items():
        run()
        seconds[name] = round(statistics.median(timed(run) for _ in range(REPEATS)), 4)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "log_rows": rows,
                "validated_logs_per_second": round(rows / seconds["validate"]),
                "ingested_logs_per_second": round(rows / seconds["ingest_batch"]),
                "loaded_logs_per_second": round(rows / seconds["bulk_load"]),
            }
        )
    )


if __name__ == "__main__":
    main()
