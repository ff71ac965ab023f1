"""Searches that skip files by the trigrams of their messages."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from cordwood.operators import listing
from cordwood.plans.params import ListingQuery
from cordwood.sources.log_table import LogTable
from cordwood.sources.trigrams import TrigramIndex, fixed_parts

DAY = datetime(2024, 1, 10, 8)
MESSAGES = ["payment declined", "User ÄRGER ΟΔΟΣ", "50% off_now", "ab", "", "disk full\nretry", "中文消息 ok", "path c:\\tmp"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    table = LogTable(spark, str(tmp_path_factory.mktemp("logs") / "logs"))
    for number, message in enumerate(MESSAGES):
        rows = [(f"{number}-{i}", DAY + timedelta(days=number % 3, seconds=i), "info", "api", f"{message}{' x' * i}", {}) for i in range(3)]
        table.append(spark.createDataFrame(rows, table.schema), f"b:{number}")
    return table


def test_fixed_parts_of_patterns():
    assert fixed_parts("%abc%") == ["abc"]
    assert fixed_parts(r"%a\%b_c\\d%%e%") == ["a%b", "c\\d", "e"]
    assert fixed_parts("%%_") == []


@pytest.mark.parametrize("mode", ["wildcard", "literal"])
def test_searches_find_the_same_rows_in_fewer_files(spark, table, mode):
    index = TrigramIndex(spark, table)
    days = table.days()
    if mode == "wildcard":
        assert len(index.candidates(days, "payment", mode)) == len(MESSAGES)  # no signatures yet
        assert index.cover(days) == len(MESSAGES)
    assert index.cover(days) == 0
    searches = ["PAYMENT", "ärger", "οδος", "declined x", "50%", "50% off_n", "off_now", "ab", "x", "full\nre", "消息", "c:\\tmp", "pay%lined", "no such text", "%", "_"]
    plain = LogTable(spark, table.path)
    for q in searches:
        asked = ListingQuery.parse({"q": q, "limit": "100"}, mode)
        expected = listing.page(plain, asked).rows
        table.trigrams = index
        assert listing.page(table, asked).rows == expected, q
    assert len(index.candidates(days, "payment", mode)) == 1
    assert index.candidates(days, "no such text", mode) == []
    assert len(index.candidates(days, "ab", mode)) == len(MESSAGES)
    files = index.scan_days(days, "declined", mode).inputFiles()
    assert len(files) == 1 and len(plain.scan_days(days).inputFiles()) == len(MESSAGES)


def test_files_without_a_signature_are_read(spark, table):
    index = TrigramIndex(spark, table)
    days = table.days()
    index.cover(days)
    table.append(spark.createDataFrame([("new", DAY, "info", "api", "fresh text", {})], table.schema), "late")
    assert len(index.candidates(days, "fresh text")) == 1
    assert index.cover(days) == 1 and len(index.candidates(days, "payment")) == 1
    table.merge(DAY.date() + timedelta(days=9))
    assert len(index.candidates(days, "fresh text")) == 3  # merged files have none yet
    assert index.cover(days) == 3 and len(index.candidates(days, "fresh text")) == 1
