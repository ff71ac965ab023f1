"""Merging of small batches, and the filter of ids that goes with a table."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cordwood.operators import buckets
from cordwood.sources.id_filter import WORDS, IdFilter, combined
from cordwood.sources.log_table import LogStore, LogTable, escaped, packed, unescaped
from cordwood.streaming import dedup

DAY = datetime(2024, 1, 10, 8)
LATER = date(2024, 2, 1)


def test_bins_hold_what_fits_and_everything_once():
    sizes = {f"b{i}": 10 + 7 * i % 50 for i in range(40)}
    bins = packed(sizes, 100)
    assert sorted(name for names in bins for name in names) == sorted(sizes)
    assert all(sum(sizes[name] for name in names) <= 100 for names in bins)
    assert len(bins) <= 1.5 * sum(sizes.values()) / 100 + 1
    assert packed({"big": 500, "small": 1}, 100) == [["big"], ["small"]]


@pytest.mark.parametrize("name", ["plain-1", "a:b/c", "50%", "x=y{z}"])
def test_folder_names_come_back(name):
    assert unescaped(escaped(name)) == name


def files_of(table, day):
    return sum(name.startswith("part-") for batch in table.visible(day) for name in table.files.statuses(f"dt={day}", f"batch={escaped(batch)}"))


def rows_of(table):
    return sorted(tuple(map(str, row)) for row in table.read().drop("dt", "batch").collect())


def test_micro_batches_of_a_day_become_one_file(spark, logs, tmp_path):
    table = LogTable(spark, str(tmp_path / "logs"))
    for number in range(12):
        table.append(logs(*[(f"{number}-{i}", DAY + timedelta(days=i % 2, minutes=number)) for i in range(6)]), f"s:{number}")
    before, listed = rows_of(table), table.read()
    assert files_of(table, "2024-01-10") == 12
    assert table.merge(date(2024, 1, 11), {"s:11"}) == 11  # one closed day, the last batch spared
    assert rows_of(table) == before and files_of(table, "2024-01-10") == 2 and files_of(table, "2024-01-11") == 12
    assert listed.count() == len(before)  # a reader that had listed the batches goes on
    assert table.merge(date(2024, 1, 11), {"s:11"}) == 0
    assert table.merge(LATER) == 2 + 12 and rows_of(table) == before
    assert files_of(table, "2024-01-10") == 1
    assert table.batches("2024-01-10") == {f"s:{i}" for i in range(12)}
    stored = table.read().where("dt = '2024-01-10'").select("timestamp").collect()
    assert [r[0] for r in stored] == sorted(r[0] for r in stored)
    now = datetime.now() + timedelta(days=2)
    assert table.sweep(now, timedelta(days=4)) == 0 and table.sweep(now, timedelta(hours=1)) > 0
    assert rows_of(table) == before and table.sweep(now) == 0
    with pytest.raises(ValueError, match="merged"):
        table.append(logs(("x", DAY)), "s:3")
    table.append(logs(("x", DAY)), "new")
    assert len(rows_of(table)) == len(before) + 1


def test_an_unfinished_merge_is_not_seen(spark, logs, tmp_path, monkeypatch):
    table = LogTable(spark, str(tmp_path / "logs"))
    for number in range(4):
        table.append(logs((f"{number}", DAY)), f"{number}")
    whole = table.files.write

    def broken(text, *parts):
        if parts[0] == "_merges":
            raise RuntimeError("lost")
        whole(text, *parts)

    monkeypatch.setattr(table.files, "write", broken)
    with pytest.raises(RuntimeError):
        table.merge(LATER)
    assert len(rows_of(table)) == 4 and table.files.statuses("dt=2024-01-10").keys() > {"batch=0"}
    monkeypatch.undo()
    assert table.merge(LATER) == 4 and len(rows_of(table)) == 4


def test_only_a_repeated_write_looks_at_the_days(spark, logs, tmp_path, monkeypatch):
    table = LogTable(spark, str(tmp_path / "logs"))
    looked = []
    monkeypatch.setattr(table, "_batch_files", lambda batch: looked.append(batch) or {})
    table.append(logs(("a", DAY)), "1")
    table.append(logs(("b", DAY)), "2")
    table.append(logs(("b", DAY)), "2")
    assert looked == ["2"]


def test_merged_rollups_count_the_same(spark, logs, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    for number in range(5):
        rows = logs(*[(f"{number}-{i}", DAY + timedelta(seconds=i)) for i in range(50)])
        store.logs.append(rows, f"{number}")
        store.rollup.write(buckets.minute_rollup(rows), f"{number}")
    assert store.rollup.read().count() == 5
    assert store.merge(LATER) == 10
    assert [row["count"] for row in store.rollup.read().collect()] == [250]
    assert store.logs.read().count() == 250


def test_a_batch_of_new_ids_reads_no_stored_ids(spark, logs, tmp_path, monkeypatch):
    table = LogTable(spark, str(tmp_path / "logs"))
    ids = IdFilter(spark, table, blocks=512)
    scanned = []
    scan = table.scan_days
    monkeypatch.setattr(table, "scan_days", lambda days: scanned.append(days) or scan(days))

    def fresh(number):
        return logs(*[(f"{number}-{i}", DAY + timedelta(minutes=i)) for i in range(100)])

    for number in range(4):
        assert dedup.append_new(fresh(number), table, f"{number}", ids) == 0
    assert not scanned
    assert dedup.append_new(fresh(2).union(fresh(9)), table, "again", ids) == 100
    assert scanned == [["2024-01-10"]]
    assert table.read().count() == 500 and table.read().select("id").distinct().count() == 500
    # A batch that is written again is not held against itself.
    assert dedup.append_new(fresh(9), table, "again", ids) == 0
    assert table.read().count() == 500
    assert table.merge(LATER, {"again"}) and ids.rows.merge(LATER, {"again"})
    assert dedup.append_new(fresh(0).union(fresh(10)), table, "5", IdFilter(spark, table)) == 100
    assert table.read().count() == 600


def test_rows_that_came_without_bits_are_covered(spark, logs, tmp_path):
    table = LogTable(spark, str(tmp_path / "logs"))
    table.load(logs(("a", DAY), ("b", DAY)), "load")
    ids = IdFilter(spark, table, blocks=64)
    dedup.append_new(logs(("a", DAY), ("c", DAY)), table, "1", ids)
    assert sorted(r["id"] for r in table.read().collect()) == ["a", "b", "c"]
    assert ids.cover(["2024-01-10"], "2") == 0
    table.load(logs(("d", DAY)), "load")  # the same batch, other rows
    dedup.append_new(logs(("a", DAY), ("d", DAY)), table, "2", ids)
    assert sorted(r["id"] for r in table.read().collect()) == ["a", "c", "d"]


def test_filters_of_parts_make_that_of_the_whole(spark, logs, tmp_path):
    ids = IdFilter(spark, LogTable(spark, str(tmp_path / "logs")), blocks=4)
    rows = logs(*[(f"{i}", DAY) for i in range(300)])
    placed = ids.placed(rows).select("hour", "block", *WORDS)
    whole = combined(placed)
    parts = combined(combined(placed.where("block < 2 or w0 > 0")).union(combined(placed)))
    assert sorted(whole.collect()) == sorted(parts.collect()) and whole.count() == 4
    bits = placed.select(*[F.bit_count(word).alias(word) for word in WORDS]).distinct().collect()
    assert [tuple(row) for row in bits] == [(1,) * 8]
