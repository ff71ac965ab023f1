from __future__ import annotations

from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from cordwood.functions.text import search_pattern
from cordwood.plans.params import BucketQuery, Cursor, ListingQuery, QueryError, parse_instant

RANGE = {"since": "2026-07-20T14:00:00Z", "until": "2026-07-20T15:00:00Z"}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2026-07-20T14:32Z", datetime(2026, 7, 20, 14, 32)),
        ("2026-07-20T14:32:01Z", datetime(2026, 7, 20, 14, 32, 1)),
        ("2026-07-20T14:32:01.1Z", datetime(2026, 7, 20, 14, 32, 1, 100_000)),
        ("2026-07-20T14:32:01.123999Z", datetime(2026, 7, 20, 14, 32, 1, 123_000)),
    ],
)
def test_instants(text, expected):
    assert parse_instant(text) == expected


@pytest.mark.parametrize(
    "text",
    ["1609459200", "2026-07-20", "2026-02-30T00:00:00Z", "2026-07-20T14:32:01+02:00",
     "2026-07-20T14:32:01", "2026-07-20T24:00:00Z", "2026-07-20T14:32:01Z\n", ""],
)
def test_refused_instants(text):
    with pytest.raises(ValueError):
        parse_instant(text)


def test_listing_defaults():
    query = ListingQuery.parse({})
    assert query.limit == 100 and query.cursor is None and query.attributes == ()


@pytest.mark.parametrize("limit", ["0", "1001", "-1", "1.5", "ten", "", "5\n", ["1", "2"]])
def test_refused_limits(limit):
    with pytest.raises(QueryError):
        ListingQuery.parse({"limit": limit})


@pytest.mark.parametrize("limit", ["1", "1000", "007"])
def test_limits(limit):
    assert ListingQuery.parse({"limit": limit}).limit == int(limit)


def test_equal_ends_suit_the_listing_only():
    same = {"since": RANGE["since"], "until": RANGE["since"]}
    ListingQuery.parse(same)
    with pytest.raises(QueryError):
        BucketQuery.parse({**same, "bucket": "1h"})
    with pytest.raises(QueryError):
        ListingQuery.parse({"since": RANGE["until"], "until": RANGE["since"]})


def test_bucket_parameters_are_required():
    with pytest.raises(QueryError) as caught:
        BucketQuery.parse({})
    assert {name for name, _ in caught.value.issues} == {"bucket", "since", "until"}


@pytest.mark.parametrize(
    "bad", [{"bucket": "2h"}, {"group_by": "message"}, {"level": "fatal"}, {"service": ["a", "b"]}]
)
def test_refused_choices(bad):
    with pytest.raises(QueryError):
        BucketQuery.parse({**RANGE, "bucket": "1h", **bad})


def test_attributes_ignore_repeated_ones():
    query = ListingQuery.parse({"attr.a": "1", "attr.b": ["1", "2"], "attr.": "x", "other": "y"})
    assert query.attributes == (("a", "1"), ("", "x"))


@given(st.datetimes(min_value=datetime(1900, 1, 1)), st.text())
def test_cursor_round_trip(ts, id_):
    try:
        id_.encode()
    except UnicodeEncodeError:
        return
    cursor = Cursor(ts.replace(microsecond=ts.microsecond // 1000 * 1000), id_)
    assert Cursor.decode(cursor.encode()) == cursor


@pytest.mark.parametrize("text", ["", "x", "e30", "bnVsbA", "W10", "eyJ0aW1lc3RhbXAiOjEsImlkIjoiYSJ9"])
def test_refused_cursors(text):
    with pytest.raises(QueryError):
        Cursor.decode(text)


@pytest.mark.parametrize(
    "q, wildcard, literal",
    [
        ("abc", "%abc%", "%abc%"),
        ("a%b_", "%a%b_%", r"%a\%b\_%"),
        (r"a\b", r"%a\\b%", r"%a\\b%"),
        (r"a\%", r"%a\%%", r"%a\\\%%"),
        (r"a\\b", r"%a\\b%", r"%a\\\\b%"),
    ],
)
def test_search_patterns(q, wildcard, literal):
    assert search_pattern(q, "wildcard") == wildcard
    assert search_pattern(q, "literal") == literal
