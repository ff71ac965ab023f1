"""A third of all rows under one key: results against plain counting, and plans that merge early."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cordwood.operators import buckets, ingest, listing, reconcile
from cordwood.operators.percentile import exact_percentile
from cordwood.plans.params import BucketQuery, ListingQuery

T0 = datetime(2026, 7, 20, 14)
ROWS = 6000


@pytest.fixture(scope="module")
def skewed(spark):
    """Every third row is the same one; the others are spread over ten minutes."""
    n = F.col("n")
    hot = n % 3 == 0
    key = F.when(hot, F.lit("hot")).otherwise(F.format_string("id-%05d", n))
    millis = F.when(hot, F.lit(0)).otherwise((n * 7919) % 600_000)
    start = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000)
    return (
        spark.range(ROWS)
        .withColumnRenamed("id", "n")
        .select(
            key.alias("id"),
            F.timestamp_millis(F.lit(start) + millis).cast("timestamp_ntz").alias("timestamp"),
            F.lit("info").alias("level"),
            F.when(hot, "hot").otherwise("cold").alias("service"),
            F.concat(F.lit("m-"), key).alias("message"),
            F.create_map(F.lit("k"), key).alias("attributes"),
        )
        .repartition(8)
        .cache()
    )


def test_copies_merge(skewed):
    merged = ingest.drop_redelivered(skewed)
    assert merged.count() == merged.select("id").distinct().count() == ROWS * 2 // 3 + 1
    assert tuple(reconcile.distinct_ids(skewed).first()) == (ROWS, ROWS * 2 // 3 + 1, False)
    surplus = reconcile.surplus_rows(reconcile.copy_counts(merged, skewed)).collect()
    assert [tuple(r) for r in surplus] == [("hot", "m-hot", ROWS // 3 - 1)]


def test_counts_merge_before_the_shuffle(skewed):
    span = {"since": "2026-07-20T13:00:00Z", "until": "2026-07-20T15:00:00Z"}
    query = BucketQuery.parse({**span, "bucket": "1m", "group_by": "service"})
    counted = buckets.bucket_counts(skewed, query)
    expected = Counter(
        (r["timestamp"].replace(second=0, microsecond=0), r["service"]) for r in skewed.collect()
    )
    assert {(r["start"], r["group"]): r["count"] for r in counted.collect()} == expected
    assert "partial_count" in counted._jdf.queryExecution().toString()


def test_pages_through_a_crowd(skewed):
    expected = sorted(((r["timestamp"], r["id"]) for r in skewed.collect()), reverse=True)
    rows = listing.top_rows(skewed, ListingQuery.parse({}), 1001, direct_bytes=0).collect()
    assert [(r["timestamp"], r["id"]) for r in rows] == expected[:1001]
    until = ListingQuery.parse({"until": (T0 + timedelta(milliseconds=1)).isoformat() + "Z"})
    crowd = listing.top_rows(skewed, until, 50, direct_bytes=0).collect()
    assert {r["id"] for r in crowd} == {"hot"} and len(crowd) == 50
    placed = listing.numbered(skewed).orderBy("position").collect()
    assert [(r["timestamp"], r["id"]) for r in placed] == expected


def test_percentile_of_a_heavy_group(spark):
    rng = np.random.default_rng(11)
    values = {"hot": rng.exponential(50, 20_000), "cold": rng.exponential(5, 100)}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    found = {r["g"]: r["percentile"] for r in exact_percentile(df, ["g"], "v", 0.95, 500).collect()}
    for group, vs in values.items():
        assert found[group] == pytest.approx(np.quantile(vs, 0.95), rel=1e-12)
