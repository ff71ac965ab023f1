from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from cordwood.operators import buckets
from cordwood.plans.params import BucketQuery

T0 = datetime(2026, 7, 20, 14)


def at(**delta):
    return T0 + timedelta(**delta)


def counts(df, **params):
    base = {"since": "2026-07-20T13:00:00Z", "until": "2026-07-21T14:00:00Z"}
    raw = {name.replace("attr_", "attr."): value for name, value in {**base, **params}.items()}
    return [tuple(r) for r in buckets.bucket_counts(df, BucketQuery.parse(raw)).collect()]


def test_widths(logs):
    df = logs(("a", at(seconds=59)), ("b", at(minutes=1)), ("c", at(minutes=4)), ("d", at(hours=11)))
    assert counts(df, bucket="1m") == [
        (T0, None, 1), (at(minutes=1), None, 1), (at(minutes=4), None, 1), (at(hours=11), None, 1),
    ]
    assert counts(df, bucket="5m") == [(T0, None, 3), (at(hours=11), None, 1)]
    assert counts(df, bucket="1h") == [(T0, None, 3), (at(hours=11), None, 1)]
    assert counts(df, bucket="1d") == [
        (datetime(2026, 7, 20), None, 3), (datetime(2026, 7, 21), None, 1),
    ]


def test_both_ends_are_exclusive(logs):
    tick = timedelta(milliseconds=1)
    df = logs(("a", T0), ("b", T0 + tick), ("c", at(minutes=1) - tick), ("d", at(minutes=1)))
    found = counts(df, bucket="1h", since="2026-07-20T14:00:00Z", until="2026-07-20T14:01:00Z")
    assert found == [(T0, None, 2)]


def test_groups_and_totals(logs):
    df = logs(("a", T0, "error", "x"), ("b", T0, "error", "y"), ("c", T0, "info", "x"))
    assert counts(df, bucket="1h", group_by="level") == [(T0, "error", 2), (T0, "info", 1)]
    assert counts(df, bucket="1h", group_by="service", level="error") == [(T0, "x", 1), (T0, "y", 1)]
    query = BucketQuery.parse(
        {"since": "2026-07-20T13:00:00Z", "until": "2026-07-20T15:00:00Z", "bucket": "1d", "group_by": "level"}
    )
    by_level = buckets.bucket_counts(df, query)
    assert buckets.bucket_total(by_level).first()["total"] == 3
    assert {r["group"]: r["total"] for r in buckets.group_totals(by_level).collect()} == {"error": 2, "info": 1}
    assert buckets.bucket_total(by_level.limit(0)).first()["total"] == 0


def test_before_1970(logs):
    df = logs(("a", datetime(1969, 12, 31, 23, 59, 59)))
    found = counts(df, bucket="1d", since="1969-01-01T00:00:00Z")
    assert found == [(datetime(1969, 12, 31), None, 1)]


@pytest.mark.parametrize(
    "since, until",
    [
        ("2026-07-20T14:00:00Z", "2026-07-20T15:00:00Z"),
        ("2026-07-20T14:00:00.001Z", "2026-07-20T14:59:30Z"),
        ("2026-07-20T14:02:30Z", "2026-07-20T14:02:40Z"),
        ("2026-07-20T14:02:30Z", "2026-07-20T14:03:00Z"),
        ("2026-07-20T14:02:30Z", "2026-07-20T14:03:10Z"),
        ("2026-07-20T13:59:00Z", "2026-07-20T14:00:00Z"),
    ],
)
@pytest.mark.parametrize("extra", [{}, {"group_by": "service"}, {"level": "error"}, {"q": "m1"}])
def test_rollup_gives_the_same_counts(logs, since, until, extra):
    rows = [
        (f"{i}", at(seconds=i * 10), ("info", "error")[i % 2], f"s{i % 3}", f"m{i}") for i in range(400)
    ]
    df = logs(*rows)
    query = BucketQuery.parse({"since": since, "until": until, "bucket": "5m", **extra})
    plain = buckets.bucket_counts(df, query).collect()
    assert buckets.bucket_counts_from_rollup(buckets.minute_rollup(df), df, query).collect() == plain
