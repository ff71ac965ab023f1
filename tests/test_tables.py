from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cordwood.plans.params import BucketQuery
from cordwood.operators import buckets
from cordwood.sources import readers
from cordwood.plans import requests
from cordwood.schema import RECEIPT_SCHEMA
from cordwood.sources.log_table import LogStore, LogTable, retained


def at(day, hour=0):
    return datetime(2026, 7, day, hour)


def test_a_batch_written_twice_is_there_once(spark, logs, tmp_path):
    table = LogTable(spark, str(tmp_path / "t"))
    first = logs(("a", at(1)), ("b", at(2)))
    table.append(first, "q-0")
    table.append(logs(("c", at(2))), "q-1")
    table.append(first, "q-0")
    assert sorted(r["id"] for r in table.read().collect()) == ["a", "b", "c"]
    assert table.days() == ["2026-07-01", "2026-07-02"]


def test_files_are_sorted_and_hold_narrow_times(spark, tmp_path):
    rows = spark.range(4000).select(
        F.format_string("%05d", "id").alias("id"),
        F.timestamp_seconds(F.lit(1784505600) + (F.col("id") * 7919) % 86400).cast("timestamp_ntz").alias("timestamp"),
        F.lit("info").alias("level"), F.lit("s").alias("service"), F.lit("m").alias("message"),
        F.create_map(F.lit("k"), F.lit("v")).alias("attributes"),
    )
    table = LogTable(spark, str(tmp_path / "t"))
    table.load(rows, "bulk", partitions=4)
    spans = (
        table.read().groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).orderBy("lo").collect()
    )
    assert len(spans) == 4
    assert all(earlier["hi"] <= later["lo"] for earlier, later in zip(spans, spans[1:]))
    one = spark.read.parquet(spans[0]["file"]).collect()
    keys = [(r["timestamp"], r["id"]) for r in one]
    assert keys == sorted(keys)


def test_one_crowded_time_is_split(spark, tmp_path):
    rows = spark.range(4000).select(
        F.format_string("%05d", "id").alias("id"),
        F.lit(at(5)).cast("timestamp_ntz").alias("timestamp"),
        F.lit("info").alias("level"), F.lit("s").alias("service"), F.lit("m").alias("message"),
        F.create_map(F.lit("k"), F.lit("v")).alias("attributes"),
    )
    table = LogTable(spark, str(tmp_path / "t"))
    table.load(rows, "bulk", partitions=4)
    sizes = table.read().groupBy(F.col("_metadata.file_path")).count().collect()
    assert len(sizes) >= 3 and max(r["count"] for r in sizes) < 2500


def test_retention(spark, logs, tmp_path):
    table = LogTable(spark, str(tmp_path / "t"))
    table.load(logs(("a", at(1)), ("b", at(2, 11)), ("c", at(2, 12)), ("d", at(3))), "x")
    now = datetime(2026, 8, 1, 12)
    assert sorted(r["id"] for r in retained(table.read(), now).collect()) == ["c", "d"]
    assert table.expire(now) == ["2026-07-01"]
    assert sorted(r["id"] for r in table.read().collect()) == ["b", "c", "d"]


def test_a_batch_written_again_leaves_nothing_of_its_first_form(spark, logs, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"))
    store.load(logs(("a", at(1)), ("b", at(2))), "x: 1")
    store.load(logs(("z", at(1))), "y")
    store.load(logs(("c", at(2))), "x: 1")
    assert sorted(r["id"] for r in store.logs.read().collect()) == ["c", "z"]
    assert store.rollup.read().agg(F.sum("count")).first()[0] == 2


def test_a_row_of_year_0_and_one_without_a_day_break_nothing(spark, logs, tmp_path):
    store = LogStore(spark, str(tmp_path / "s"))
    zero = logs(("zero", at(1))).withColumn("timestamp", F.lit("0000-01-01 00:00:00").cast("timestamp_ntz"))
    store.load(logs(("a", at(1)), ("b", at(2))).unionByName(zero), "x")
    found = requests.get_logs(store, {"limit": "10"})["logs"]
    assert [r["id"] for r in found] == ["b", "a", "zero"]
    assert found[-1]["timestamp"] == "0000-01-01T00:00:00.000Z"
    assert [r["id"] for r in requests.get_logs(store, {"since": "2026-07-02T00:00:00Z"})["logs"]] == ["b"]
    range_ = {"since": "2026-06-30T00:00:00Z", "until": "2026-07-05T00:00:00Z", "bucket": "1d"}
    assert [r["count"] for r in requests.get_aggregate(store, range_)] == [1, 1]
    receipt = spark.createDataFrame([("r", None)], "request_id string, received_at timestamp_ntz")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in RECEIPT_SCHEMA.fields if f.name not in receipt.columns]
    store.receipts.write(receipt.select("*", *empty), "x")
    assert store.receipts.read().count() == 1 and store.receipts.days() == []
    assert store.expire(datetime(2026, 8, 1, 12)) == ["0000-01-01", "2026-07-01"]


def test_bucket_query_prunes_days_and_columns(spark, logs, tmp_path):
    table = LogTable(spark, str(tmp_path / "t"))
    table.load(logs(*[(f"{d}", at(d, 5)) for d in range(1, 20)]), "x")
    query = BucketQuery.parse(
        {"since": "2026-07-05T00:00:00Z", "until": "2026-07-07T00:00:00Z", "bucket": "1d", "group_by": "level"}
    )
    counted = buckets.bucket_counts(table.read(), query)
    assert [r["start"].day for r in counted.collect()] == [5, 6]
    plan = counted._jdf.queryExecution().toString()
    assert "ReadSchema: struct<timestamp:timestamp_ntz,level:string>" in plan
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert ">= 2026-07-05" in filters and "<= 2026-07-06" in filters


def test_bulk_lines(spark, tmp_path):
    lines = tmp_path / "rows.json"
    row = {"timestamp": "2026-07-01 02:03:04.567", "level": "warn", "service": "a", "message": "m"}
    lines.write_text("\n".join(json.dumps(r) for r in (row, {**row, "attributes": {"k": "v"}}, {**row, "id": "x"})))
    rows = readers.read_bulk(spark, str(lines)).collect()
    assert all(r["timestamp"] == datetime(2026, 7, 1, 2, 3, 4, 567_000) for r in rows)
    assert len({r["id"] for r in rows}) == 3 and "x" in {r["id"] for r in rows}
    assert [r["attributes"] for r in rows] == [{}, {"k": "v"}, {}]
    lines.write_text('{"timestamp": "soon"}')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        readers.read_bulk(spark, str(lines)).collect()
