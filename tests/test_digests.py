"""Digest trees of two sides."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from cordwood.operators import digests

DAY = datetime(2024, 1, 10, 8)


def test_only_leaves_that_differ_are_read(spark, logs, tmp_path):
    rows = [(f"{i}", DAY + timedelta(days=i % 4, seconds=i)) for i in range(400)]
    left = logs(*rows)
    # One lost, one new, one twice, and one twice that was there once.
    other = [row for row in rows if row[0] != "7"] + [("new", DAY), rows[20], rows[21], rows[21]]
    right = logs(*other)
    tables = {}
    for name, side in (("left", left), ("right", right)):
        table = digests.digest_table(spark, str(tmp_path / name))
        for number in range(3):
            table.write(digests.digests(side.where(f"pmod(xxhash64(id), 3) = {number}")), f"{number}")
        table.merge(date(2024, 1, 12))
        tables[name] = table.read()
    leaves = digests.differing_leaves(tables["left"], tables["right"])
    found = {r["id"]: (r["expected"], r["found"]) for r in digests.differences(left, right, leaves).collect()}
    assert found == {"7": (1, 0), "new": (0, 1), "20": (1, 2), "21": (1, 3)}
    assert leaves.count() <= 4


def test_equal_sides_read_no_rows(spark, logs):
    rows = logs(*[(f"{i}", DAY + timedelta(hours=i)) for i in range(50)])
    shuffled = rows.orderBy("message", "id").repartition(3)
    leaves = digests.differing_leaves(digests.digests(rows), digests.digests(shuffled))
    assert leaves.count() == 0
    unreadable = rows.where("raise_error('read') is null")
    assert digests.differences(unreadable, unreadable, leaves).count() == 0
