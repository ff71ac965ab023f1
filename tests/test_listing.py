from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cordwood.operators import listing
from cordwood.operators.filters import time_bounds
from cordwood.plans.params import ListingQuery
from cordwood.sources.log_table import LogTable

T0 = datetime(2026, 7, 20, 14)
TICK = timedelta(milliseconds=1)


def ids(df, **params):
    raw = {name.replace("attr_", "attr."): value for name, value in params.items()}
    mode = raw.pop("mode", "wildcard")
    return [row["id"] for row in listing.listing(df, ListingQuery.parse(raw, mode)).collect()]


def test_order_and_output(logs):
    df = logs(("a", T0), ("c", T0), ("b", T0 + TICK))
    assert ids(df) == ["b", "c", "a"]
    first = listing.listing(df, ListingQuery.parse({})).first()
    assert first["timestamp"] == "2026-07-20T14:00:00.001Z"


def test_since_inclusive_until_exclusive(logs):
    df = logs(("a", T0 - TICK), ("b", T0), ("c", T0 + TICK), ("d", T0 + 2 * TICK))
    found = ids(df, since="2026-07-20T14:00:00Z", until="2026-07-20T14:00:00.002Z")
    assert found == ["c", "b"]
    assert ids(df, since="2026-07-20T14:00:00Z", until="2026-07-20T14:00:00Z") == []


def test_equality_filters_and_empty_ones(logs):
    df = logs(("a", T0, "error", "x"), ("b", T0, "info", "x"), ("c", T0, "info", "y"))
    assert ids(df, service="x") == ["b", "a"]
    assert ids(df, level="info") == ["c", "b"]
    assert ids(df, service="", q="") == ["c", "b", "a"]


@pytest.mark.parametrize(
    "q, mode, expected",
    [
        ("DECLINED", "wildcard", "a"),
        ("100%", "wildcard", "bc"),
        ("100%", "literal", "b"),
        (r"100\%", "wildcard", "b"),
        ("a_b", "wildcard", "de"),
        ("a_b", "literal", "d"),
        ("c:\\dir", "wildcard", "f"),
        ("c:\\dir", "literal", "f"),
        ("dir\\", "literal", "f"),
        ("É", "wildcard", "g"),
    ],
)
def test_search(logs, q, mode, expected):
    texts = {
        "a": "payment declined", "b": "at 100% now", "c": "1000 left", "d": "a_b", "e": "axb",
        "f": "C:\\dir\\file", "g": "café",
    }
    df = logs(*[(id_, T0, "info", "s", text) for id_, text in texts.items()])
    assert sorted(ids(df, q=q, mode=mode)) == sorted(expected)


def test_attributes(logs):
    def row(id_, attributes):
        return (id_, T0, "info", "s", "m", attributes)

    df = logs(row("a", {"k": "1", "l": "2"}), row("b", {"k": "1"}), row("c", {"k": ""}), row("d", {}))
    assert ids(df, attr_k="1") == ["b", "a"]
    assert ids(df, attr_k="1", attr_l="2") == ["a"]
    assert ids(df, attr_k="") == ["d", "c"]


def test_pages_cross_equal_times(logs):
    times = [T0, T0, T0, T0 + TICK, T0 + TICK]
    df = logs(*[(f"id{i}", ts) for i, ts in enumerate(times)])
    pages = list(listing.walk(df, ListingQuery.parse({"limit": "2"})))
    assert [[row["id"] for row in p.rows] for p in pages] == [["id4", "id3"], ["id2", "id1"], ["id0"]]
    assert pages[-1].next_cursor is None
    lazy = listing.next_page(df, ListingQuery.parse({"limit": "2"})).first()
    assert lazy["has_next"] and lazy["next_cursor"] == pages[0].next_cursor


def test_full_last_page_has_no_successor(logs):
    df = logs(("a", T0), ("b", T0))
    assert listing.page(df, ListingQuery.parse({"limit": "2"})).next_cursor is None
    assert listing.page(df.limit(0), ListingQuery.parse({})).rows == []


def _many(spark):
    """600 rows over six days, 25 to a time."""
    n = F.col("n")
    return spark.range(600).withColumnRenamed("id", "n").select(
        F.format_string("%05d", (n * 7919) % 600).alias("id"),
        F.timestamp_seconds(F.lit(1784505600) + F.floor(n / 25) * 21600).cast("timestamp_ntz").alias("timestamp"),
        F.lit("info").alias("level"),
        F.concat(F.lit("s"), n % 3).alias("service"),
        F.lit("m").alias("message"),
        F.create_map(F.lit("k"), F.lit("v")).alias("attributes"),
    )


def test_walk_equals_sort_and_positions(spark):
    df = _many(spark).cache()
    expected = [r["id"] for r in df.orderBy(F.desc("timestamp"), F.desc("id")).collect()]
    walked = [r["id"] for p in listing.walk(df, ListingQuery.parse({"limit": "70"})) for r in p.rows]
    assert walked == expected
    placed = {r["position"]: r["id"] for r in listing.numbered(df.repartition(7)).collect()}
    assert [placed[i] for i in range(600)] == expected
    pages = listing.pages(df, 70).orderBy("page").collect()
    assert [p["rows"] for p in pages] == [70] * 8 + [40]
    assert [p["first_id"] for p in pages] == expected[::70]


def test_wide_and_direct_ways_agree(spark):
    df = _many(spark)
    for params, count in (({}, 40), ({"service": "s1"}, 101), ({"service": "none"}, 5), ({}, 1001)):
        query = ListingQuery.parse(params)
        wide = listing.top_rows(df.repartition(9), query, count, direct_bytes=0)
        assert wide.collect() == listing.top_rows(df, query, count, direct_bytes=1 << 62).collect()
        assert "WindowGroupLimit" in wide._jdf.queryExecution().toString()


def test_one_crowded_minute_is_thinned_by_lane(spark, logs):
    df = logs(*[(f"{i:04d}", T0 + (i % 3) * TICK) for i in range(900)]).repartition(8)
    query = ListingQuery.parse({})
    wide = listing.top_rows(df, query, 30, direct_bytes=0).collect()
    assert wide == listing.top_rows(df, query, 30, direct_bytes=1 << 62).collect()


def test_stored_table_reads_days_as_needed(spark, tmp_path):
    df = _many(spark)
    table = LogTable(spark, str(tmp_path / "logs"))
    assert listing.page(table, ListingQuery.parse({})).rows == []
    table.load(df, "one")
    for params in (
        {"limit": "30"},
        {"limit": "1000"},
        {"limit": "250", "service": "s1"},
        {"limit": "40", "since": "2026-07-21T06:00:00Z", "until": "2026-07-23T00:00:00Z"},
        {"service": "none"},
    ):
        query = ListingQuery.parse(params)
        stored = [p for p in listing.walk(table, query)]
        plain = [p for p in listing.walk(df, query)]
        assert [p.next_cursor for p in stored] == [p.next_cursor for p in plain]
        assert [r["id"] for p in stored for r in p.rows] == [r["id"] for p in plain for r in p.rows]


def test_plan_prunes_and_keeps_the_top(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "logs"))
    table.load(_many(spark), "one")
    query = ListingQuery.parse({"since": "2026-07-22T00:00:00Z", "until": "2026-07-22T12:00:00Z", "service": "s1"})
    assert all("dt=2026-07-22" in f for f in table.scan(*time_bounds(query)).inputFiles())
    plan = listing.listing(table.read(), query)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    assert "dt#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(service,s1)" in pushed and "GreaterThanOrEqual(timestamp" in pushed
