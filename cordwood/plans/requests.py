"""The three requests of the log service, against a store: post a batch, list, count.

Parameters arrive as a mapping of request parameters and are refused with ``QueryError``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence
from datetime import datetime

from pyspark.sql import functions as F

from cordwood.functions.times import format_iso, instant
from cordwood.operators import listing
from cordwood.operators.buckets import bucket_counts, bucket_counts_from_rollup, rollup_answers
from cordwood.operators.filters import time_bounds
from cordwood.plans.params import BucketQuery, ListingQuery, format_instant
from cordwood.session import configure
from cordwood.sources.log_table import LogStore
from cordwood.streaming.ingest import write_batch


def post_logs(
    store: LogStore, bodies: Mapping[str, str], now: datetime, batch: str
) -> dict[str, dict]:
    """Ingest request bodies by request id; their receipts, once their logs can be read.

    The stored batch is named after ``batch`` and the request ids: the same requests posted again
    replace themselves, others never do, whatever ``batch`` they name.
    """
    ids = json.dumps(sorted(bodies))
    batch = f"{batch}-{hashlib.sha256(ids.encode()).hexdigest()[:32]}"
    spark = configure(store.spark)
    requests = spark.createDataFrame(list(bodies.items()), "request_id string, body string")
    write_batch(requests.withColumn("received_at", instant(now)), store, batch)
    receipts = store.receipts.scan(now, now).where(F.col("batch") == batch)
    return {
        row["request_id"]: {
            "status": row["http_status"],
            "accepted": row["accepted"],
            "rejected": [part.asDict() for part in row["rejected"]],
        }
        for row in receipts.collect()
    }


def get_logs(store: LogStore, params: Mapping[str, object], search_mode: str = "wildcard") -> dict:
    """One page of logs, newest first, and the cursor of the next."""
    configure(store.spark)
    page = listing.page(store.logs, ListingQuery.parse(params, search_mode))
    rows = [
        {**row.asDict(), "timestamp": _time_text(row["timestamp"])} for row in page.rows
    ]
    return {"logs": rows, "next_cursor": page.next_cursor}


def _time_text(time: datetime | str) -> str:
    return time if isinstance(time, str) else format_instant(time)


def get_aggregate(
    store: LogStore, params: Mapping[str, object], search_mode: str = "wildcard"
) -> Iterator[dict]:
    """Bucket counts in order, one partition at a time; from the rollup where that can answer."""
    configure(store.spark)
    query = BucketQuery.parse(params, search_mode)
    bounds = time_bounds(query)
    logs = store.logs.scan(*bounds)
    if rollup_answers(query):
        counts = bucket_counts_from_rollup(store.rollup.scan(*bounds), logs, query)
    else:
        counts = bucket_counts(logs, query)
    for row in counts.withColumn("start", format_iso(F.col("start"))).toLocalIterator():
        yield row.asDict()


def pages(store: LogStore, params: Mapping[str, object]) -> Iterator[Sequence[dict]]:
    """All pages of a listing."""
    while True:
        answer = get_logs(store, params)
        yield answer["logs"]
        if answer["next_cursor"] is None:
            return
        params = {**params, "cursor": answer["next_cursor"]}
