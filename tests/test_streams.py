from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cordwood.operators import buckets, ingest
from cordwood.plans.params import BucketQuery
from cordwood.schema import LOG_SCHEMA
from cordwood.sources import readers
from cordwood.sources.log_table import LogStore, LogTable
from cordwood.streaming import buckets as stream_buckets
from cordwood.streaming import dedup, slices
from cordwood.streaming import ingest as stream_ingest

NOW = datetime(2026, 7, 20, 15)


def request(number):
    entries = [
        {
            "timestamp": (NOW - timedelta(days=number % 3, seconds=i)).isoformat() + "Z",
            "level": "critical" if i == 2 else "info",
            "service": f"s{i % 2}",
            "message": f"m{number}-{i}",
            "attributes": {"n": i},
        }
        for i in range(5)
    ]
    return {"request_id": f"req-{number}", "body": json.dumps({"logs": entries}), "received_at": NOW.isoformat()}


def put(folder, name, numbers):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(request(n)) for n in numbers))


def run(spark, tmp_path, store, **options):
    source = readers.stream_envelopes(spark, str(tmp_path / "in"), max_files=1)
    query = stream_ingest.start_ingest(source, store, str(tmp_path / "progress"), **options)
    query.awaitTermination()
    return query


def test_stream_equals_batch_and_goes_on_after_a_stop(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    put(tmp_path / "in", "a.json", range(3))
    put(tmp_path / "in", "b.json", range(3, 5))
    run(spark, tmp_path, store)
    assert store.receipts.read().select("batch").distinct().count() == 2
    put(tmp_path / "in", "c.json", [5, 6])
    run(spark, tmp_path, store)
    run(spark, tmp_path, store)

    validated = ingest.validate(readers.read_envelopes(spark, str(tmp_path / "in")))
    columns = LOG_SCHEMA.fieldNames()

    def rows(df):
        return sorted(map(str, df.select(*columns).collect()))

    assert rows(store.logs.read()) == rows(ingest.accepted(validated))
    assert store.logs.read().count() == 28
    assert store.rejects.read().count() == 7
    assert store.receipts.read().agg(F.sum("accepted")).first()[0] == 28
    query = BucketQuery.parse(
        {"since": "2026-07-01T00:00:00Z", "until": "2026-07-30T00:00:00Z", "bucket": "1d", "group_by": "service"}
    )
    logs = store.logs.read()
    assert (
        buckets.bucket_counts_from_rollup(store.rollup.read(), logs, query).collect()
        == buckets.bucket_counts(logs, query).collect()
    )


def test_a_batch_that_fails_midway_is_repaired_by_its_replay(spark, tmp_path, monkeypatch):
    store = LogStore(spark, str(tmp_path / "store"))
    put(tmp_path / "in", "a.json", range(3))
    monkeypatch.setattr(store, "write_side", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception):
        run(spark, tmp_path, store)
    # Logs are written, but nothing was acknowledged.
    assert store.logs.read().count() == 12 and not store.receipts.exists()
    monkeypatch.undo()
    run(spark, tmp_path, store)
    assert store.logs.read().count() == 12
    assert store.rollup.read().agg(F.sum("count")).first()[0] == 12
    assert store.receipts.read().count() == 3


def test_a_line_that_is_no_envelope_is_refused_with_a_receipt(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    put(tmp_path / "in", "a.json", [0])
    with open(tmp_path / "in" / "a.json", "a") as file:
        file.write("\nnot json")
    run(spark, tmp_path, store)
    rows = {r["status"]: r for r in store.receipts.read().collect()}
    assert set(rows) == {"ok", "malformed_json"} and rows["malformed_json"]["received_at"] is not None


def test_writers_with_their_own_names_do_not_touch_each_other(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    for name, number in (("a", 0), ("b", 3)):
        put(tmp_path / name, "x.json", [number])
        stream_ingest.write_batch(readers.read_envelopes(spark, str(tmp_path / name)), store, f"{name}-0")
    assert store.logs.read().count() == 8


def stream_of(spark, df, folder, files=3):
    df.repartition(files).write.parquet(str(folder))
    return (
        spark.readStream.schema(spark.read.parquet(str(folder)).schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(str(folder))
    )


def test_running_counts_equal_batch_counts(spark, logs, tmp_path):
    df = logs(*[(f"{i}", NOW + timedelta(minutes=7 * i), "info", f"s{i % 2}") for i in range(60)])
    running = stream_buckets.running_counts(stream_of(spark, df, tmp_path / "in", files=7), "1h", "service")
    table = stream_buckets.counts_table(spark, str(tmp_path / "out"))
    stream_buckets.start_counts(running, table, str(tmp_path / "progress"), merge_every=3).awaitTermination()
    saved = table.read()
    query = BucketQuery.parse(
        {"since": "2026-07-20T00:00:00Z", "until": "2026-07-30T00:00:00Z", "bucket": "1h", "group_by": "service"}
    )
    expected = buckets.bucket_counts(df, query).collect()
    assert stream_buckets.current_counts(saved).orderBy("start", "group").collect() == expected
    # Seven micro-batches: what was folded, and those since.
    assert saved.groupBy("start", "group").count().agg(F.max("count")).first()[0] <= 4
    assert saved.select("batch").distinct().count() <= 3


def test_running_counts_take_rows_of_any_age(spark, logs, tmp_path):
    folder = tmp_path / "in"
    for number, days in enumerate((0, 1, 80)):
        logs((f"{number}", NOW - timedelta(days=days))).coalesce(1).write.mode("append").parquet(str(folder))
    arriving = (
        spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    )
    table = stream_buckets.counts_table(spark, str(tmp_path / "out"))
    running = stream_buckets.running_counts(arriving, "1d")
    stream_buckets.start_counts(running, table, str(tmp_path / "progress")).awaitTermination()
    assert stream_buckets.current_counts(table.read()).agg(F.sum("count")).first()[0] == 3


def test_redelivered_rows_are_dropped_however_late_and_old_ones_kept(spark, logs, tmp_path):
    fresh = logs(*[(f"{i}", NOW + timedelta(days=i)) for i in range(20)], ("ancient", datetime(1999, 1, 1)))
    copies = fresh.union(fresh.where("id < '15'"))
    table = LogTable(spark, str(tmp_path / "out"))
    arriving = stream_of(spark, copies, tmp_path / "in", files=5)
    dedup.start_dedup(arriving, table, str(tmp_path / "progress")).awaitTermination()
    stored = table.read()
    assert sorted(r["id"] for r in stored.collect()) == sorted([str(i) for i in range(20)] + ["ancient"])
    assert stored.select("batch").distinct().count() > 1


def test_slices_hold_no_more_entries_than_allowed(spark):
    counts = [3, 1, 40, 7, 25, 26, 50, 51, 120, 2] * 9 + [0]
    rows = [(f"r{i}", json.dumps({"logs": [{}] * n}), NOW, str(i % 2)) for i, n in enumerate(counts)]
    rows += [("broken", "{", NOW, "0"), ("null", None, NOW, "1")]
    envelopes = spark.createDataFrame(rows, "request_id string, body string, received_at timestamp_ntz, lane string")
    cut = slices.sliced(envelopes, 50)
    held = cut.groupBy("slice").agg(F.sum("entries").alias("entries"), F.count("*").alias("requests")).collect()
    assert cut.count() == len(rows)
    assert all(row["entries"] <= 50 or row["requests"] == 1 for row in held)
    small = sum(n for n in counts if n <= 25) + 3
    assert len(held) <= sum(n > 25 for n in counts) + small / 25 + 2


def test_a_stream_takes_a_slice_at_a_time_and_goes_on_after_a_stop(spark, tmp_path):
    arriving, cut = tmp_path / "in", str(tmp_path / "slices")
    store = LogStore(spark, str(tmp_path / "store"))

    def run_both():
        source = readers.stream_envelopes(spark, str(arriving))
        slices.start_slicing(source, cut, str(tmp_path / "cutting"), max_entries=20, lanes=2).awaitTermination()
        stream_ingest.start_ingest(slices.stream_slices(spark, cut), store, str(tmp_path / "progress")).awaitTermination()

    put(arriving, "a.json", range(12))
    run_both()
    first = {r["batch"]: r["entries"] for r in _entries(store)}
    assert len(first) > 1 and max(first.values()) <= 20
    put(arriving, "b.json", range(12, 20))
    run_both()
    run_both()
    both = {r["batch"]: r["entries"] for r in _entries(store)}
    assert max(both.values()) <= 20 and sum(both.values()) == 20 * 5
    assert {batch: both[batch] for batch in first} == first
    assert not slices.write_slices(readers.read_envelopes(spark, str(arriving)), cut, f"{0:012d}")


def _entries(store):
    held = F.sum(F.col("accepted") + F.size("rejected")).alias("entries")
    return store.receipts.read().groupBy("batch").agg(held).collect()


def test_merging_goes_on_beside_a_stream(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    for number in range(5):
        put(tmp_path / "in", f"{number}.json", [number])
    run(spark, tmp_path, store, merge_every=2)
    assert store.logs.read().count() == 20 and store.receipts.read().count() == 5
    batches = {r["batch"] for r in store.receipts.read().select("batch").distinct().collect()}
    days = store.logs.days()
    assert all(len(store.logs.visible(day)) <= 4 for day in days) and len(batches) <= 5


def test_slices_of_small_requests_are_nearly_full(spark):
    rows = [(f"r{i}", json.dumps({"logs": [{}] * 3}), NOW, "0") for i in range(60)]
    envelopes = spark.createDataFrame(rows, "request_id string, body string, received_at timestamp_ntz, lane string")
    cut = slices.sliced(envelopes, 20).groupBy("slice").agg(F.sum("entries").alias("entries")).collect()
    held = sorted(row["entries"] for row in cut)
    assert sum(held) == 180 and held[-1] <= 20
    # Cut at half the bound they would be eighteen.
    assert len(held) <= 10


def test_a_slice_is_validated_by_several_tasks(spark, tmp_path):
    put(tmp_path / "in", "a.json", range(40))
    slices.write_slices(readers.read_envelopes(spark, str(tmp_path / "in")), str(tmp_path / "slices"), "0")
    tasks = []
    writer = slices.stream_slices(spark, str(tmp_path / "slices")).writeStream.foreachBatch(
        lambda rows, number: tasks.append(rows.rdd.getNumPartitions())
    )
    writer.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    assert len(tasks) == 1 and tasks[0] > 1


def test_slices_follow_the_times_of_their_entries(spark):
    # Ids are no help: requests of four days come in turns, each with one entry that is far off.
    rows = []
    for i in range(80):
        times = [(NOW + timedelta(days=i % 4, minutes=i)).isoformat() + "Z"] * 4 + ["1970-01-01T00:00:00Z"]
        rows.append((f"r{i}", json.dumps({"logs": [{"timestamp": time} for time in times]}), NOW, "0", i % 4))
    envelopes = spark.createDataFrame(
        rows, "request_id string, body string, received_at timestamp_ntz, lane string, day int"
    )
    cut = slices.sliced(envelopes, 50)
    held = cut.groupBy("slice").agg(F.sum("entries").alias("entries"), F.countDistinct("day").alias("days")).collect()
    assert sum(row["entries"] for row in held) == 400 and max(row["entries"] for row in held) <= 50
    # 46 of 50 are used, so nine slices; a cut between two days makes one slice of two days.
    assert len(held) == 9 and sum(row["days"] for row in held) <= 9 + 3
    assert cut.columns == [*envelopes.columns, "entries", "slice"]


def test_hours_of_a_lane_are_cut_as_one_run(spark):
    def body(hour, size):
        entry = {"timestamp": (NOW + timedelta(hours=hour)).isoformat() + "Z"}
        return json.dumps({"logs": [entry] * size})

    rows = [(f"r{i}", body(i, 3), NOW, lane) for i in range(60) for lane in ("0", "1", None)]
    rows += [(None, body(7, 15), NOW, "0"), (None, None, None, "1")] + [("same", body(9, 2), NOW, "1")] * 3
    rows.append(("odd", '{"logs":[{"timestamp":{"a":1}},{"timestamp":["x"]}]}', NOW, "0"))
    envelopes = spark.createDataFrame(rows, "request_id string, body string, received_at timestamp_ntz, lane string")
    cut = slices.sliced(envelopes, 20)
    held = [row["entries"] for row in cut.groupBy("slice").agg(F.sum("entries").alias("entries")).collect()]
    assert cut.count() == len(rows) and max(held) <= 20
    assert sum(held) == 3 * 180 + 15 + 1 + 6 + 2
    # Nearly full however many hours they span: by hours they would be about 180.
    assert len(held) <= 33


def bounded_run(spark, tmp_path, store):
    taken = slices.stream_slices(spark, str(tmp_path / "slices"))
    stream_ingest.start_ingest(taken, store, str(tmp_path / "progress"), bounded=True).awaitTermination()


def test_a_bounded_stream_stores_what_a_batch_does(spark, tmp_path):
    put(tmp_path / "in", "a.json", range(12))
    with open(tmp_path / "in" / "a.json", "a") as file:
        file.write("\nnot json")
    arrived = readers.read_envelopes(spark, str(tmp_path / "in"))
    slices.write_slices(arrived, str(tmp_path / "slices"), "0", max_entries=20)
    store, plain = LogStore(spark, str(tmp_path / "store")), LogStore(spark, str(tmp_path / "plain"))
    before = {key: spark.conf.get(key, None) for key in stream_ingest._bounded_conf(spark, str(tmp_path))}
    bounded_run(spark, tmp_path, store)
    assert {key: spark.conf.get(key, None) for key in before} == before
    stream_ingest.write_batch(arrived, plain, "all")

    def rows(table):
        return sorted(map(str, table.read().drop("batch").collect()))

    for name in ("logs", "rejects", "receipts"):
        assert rows(getattr(store, name)) == rows(getattr(plain, name)), name
    counted = "start", "service", "level"
    assert rows_of_counts(store.rollup.read(), counted) == rows_of_counts(plain.rollup.read(), counted)
    assert store.receipts.read().select("batch").distinct().count() > 1
    # One file for each day and batch.
    assert all(
        len(list(folder.glob("part-*.parquet"))) == 1 for folder in (tmp_path / "store" / "logs").glob("dt=*/batch=*")
    )
    assert not list((tmp_path / "store" / "_drafts").iterdir())


def rows_of_counts(rollup, keys):
    return sorted(map(str, rollup.groupBy(*keys).agg(F.sum("count")).collect()))


def test_a_bounded_batch_that_fails_midway_is_repaired_by_its_replay(spark, tmp_path, monkeypatch):
    store = LogStore(spark, str(tmp_path / "store"))
    put(tmp_path / "in", "a.json", range(3))
    slices.write_slices(readers.read_envelopes(spark, str(tmp_path / "in")), str(tmp_path / "slices"), "0")

    def fails(*_):
        raise RuntimeError("lost")

    # Logs that cannot be written leave no receipts.
    monkeypatch.setattr(store.logs, "append", fails)
    with pytest.raises(Exception):
        bounded_run(spark, tmp_path, store)
    assert not store.logs.exists() and not store.receipts.days()
    monkeypatch.undo()
    monkeypatch.setattr(store, "show_side", fails)
    with pytest.raises(Exception):
        bounded_run(spark, tmp_path, store)
    assert store.logs.read().count() == 12 and not store.receipts.days()
    monkeypatch.undo()
    # Half of the small tables shown.
    finish = store._finish_side
    monkeypatch.setattr(store, "_finish_side", fails)
    with pytest.raises(Exception):
        bounded_run(spark, tmp_path, store)
    monkeypatch.setattr(store, "_finish_side", finish)
    bounded_run(spark, tmp_path, store)
    assert store.logs.read().count() == 12
    assert store.rollup.read().agg(F.sum("count")).first()[0] == 12
    assert store.receipts.read().count() == 3 and store.rejects.read().count() == 3
