from __future__ import annotations

import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cordwood.functions.text import number_text
from cordwood.operators import ingest
from cordwood.sources.readers import envelopes_from_queue

from .conftest import NOW

GOOD = {
    "timestamp": "2026-07-20T14:32:01.123Z",
    "level": "info",
    "service": "api",
    "message": "hello",
}


def body(*entries):
    return json.dumps({"logs": list(entries)})


def entry(**changes):
    return {k: v for k, v in {**GOOD, **changes}.items() if v is not ...}


def reasons(envelopes, *entries, **options):
    rows = ingest.rejected(ingest.validate(envelopes(body(*entries)), **options)).collect()
    return {row["index"]: row["reason"] for row in rows}


def fields(reason):
    return re.findall(r"(?:^|, )(entry|timestamp|level|service|message|attributes): ", reason)


def test_good_and_bad_entries_of_one_request(envelopes):
    found = reasons(
        envelopes,
        entry(service="billing", attributes={"cents": 1250, "refund": False}),
        entry(timestamp=1752970000000),
        entry(service=...),
        entry(level=..., service=...),
        entry(timestamp="20/07/2026 10:15"),
        {"note": "nothing of an entry"},
    )
    assert {i: fields(r) for i, r in found.items()} == {
        1: ["timestamp"], 2: ["service"], 3: ["level", "service"], 4: ["timestamp"],
        5: ["timestamp", "level", "service", "message"],
    }


@pytest.mark.parametrize(
    "number, text",
    [
        ("123456789012345", "123456789012345"),
        ("-123456789012345", "-123456789012345"),
        ("9007199254740993", "9007199254740992"),
        ("-9007199254740993", "-9007199254740992"),
        ("12345678901234567", "12345678901234568"),
    ],
)
def test_whole_numbers_read_as_doubles(envelopes, number, text):
    sent = json.dumps(entry(attributes={"n": "@"})).replace('"@"', number)
    rows = ingest.accepted(ingest.validate(envelopes('{"logs": [%s]}' % sent))).collect()
    assert [row["attributes"]["n"] for row in rows] == [text]


def test_a_number_beyond_all_doubles_is_refused(envelopes):
    sent = json.dumps(entry(attributes={"n": "@"})).replace('"@"', "1e400")
    rows = ingest.rejected(ingest.validate(envelopes('{"logs": [%s]}' % sent))).collect()
    assert [fields(row["reason"]) for row in rows] == [["attributes"]]


@pytest.mark.parametrize(
    "change, field",
    [
        ({"timestamp": 123}, "timestamp"),
        ({"timestamp": None}, "timestamp"),
        ({"timestamp": "2026-07-20T14:32:01+02:00"}, "timestamp"),
        ({"timestamp": "2026-07-20T14:32:01"}, "timestamp"),
        ({"timestamp": "2026-02-30T14:32:01Z"}, "timestamp"),
        ({"timestamp": "2026"}, "timestamp"),
        ({"timestamp": "2026-07-20T15:05:00.001Z"}, "timestamp"),
        ({"level": "INFO"}, "level"),
        ({"level": "critical"}, "level"),
        ({"level": None}, "level"),
        ({"service": 5}, "service"),
        ({"service": ""}, "service"),
        ({"message": ["x"]}, "message"),
        ({"message": ""}, "message"),
        ({"attributes": None}, "attributes"),
        ({"attributes": [1]}, "attributes"),
        ({"attributes": "x"}, "attributes"),
        ({"attributes": {"a": {"b": 1}}}, "attributes"),
        ({"attributes": {"a": [1]}}, "attributes"),
        ({"attributes": {"a": None}}, "attributes"),
    ],
)
def test_refused(envelopes, change, field):
    assert [fields(r) for r in reasons(envelopes, entry(**change)).values()] == [[field]]


@pytest.mark.parametrize(
    "change",
    [
        {"timestamp": "2026-07-20T15:05:00Z"},
        {"timestamp": "1999-01-01T00:00Z"},
        {"timestamp": "2026-07-20T14:32:01.1Z"},
        {"timestamp": "2026-07-20T14:32:01.123456789Z"},
        {"attributes": {}},
        {"attributes": {"a": 1, "b": 1.5, "c": True, "d": ""}},
        {"unknown": {"deep": [1]}},
    ],
)
def test_taken(envelopes, change):
    assert reasons(envelopes, entry(**change)) == {}


def test_empty_texts_pass_when_only_types_count(envelopes):
    assert reasons(envelopes, entry(service="", message=""), require_non_empty=False) == {}


def test_entries_that_are_no_objects(envelopes):
    found = reasons(envelopes, "text", None, 5, [1], entry())
    assert sorted(found) == [0, 1, 2, 3] and set(map(tuple, map(fields, found.values()))) == {("entry",)}


@pytest.mark.parametrize(
    "text, status",
    [
        ('{"logs":[', ingest.MALFORMED),
        ("", ingest.MALFORMED),
        (None, ingest.MALFORMED),
        ('"text"', ingest.MALFORMED),
        ('{"logs":[]} x', ingest.MALFORMED),
        ('{"logs":[]},{"logs":[]}', ingest.MALFORMED),
        ('{"logs":[]}] [', ingest.MALFORMED),
        ("{}", ingest.NO_LOGS),
        ("[]", ingest.NO_LOGS),
        ('{"logs":null}', ingest.NO_LOGS),
        ('{"logs":false}', ingest.NO_LOGS),
        ('{"logs":0}', ingest.NO_LOGS),
        ('{"logs":0.0}', ingest.NO_LOGS),
        ('{"logs":""}', ingest.NO_LOGS),
        ('{"logs":{}}', ingest.NOT_A_LIST),
        ('{"logs":true}', ingest.NOT_A_LIST),
        ('{"logs":"x"}', ingest.NOT_A_LIST),
        ('{"logs":[]}', ingest.NO_VALID),
        ('{"logs":[{}]}', ingest.NO_VALID),
        (' \n' + body(GOOD) + "\n", ingest.OK),
    ],
)
def test_status(envelopes, text, status):
    row = ingest.receipts(ingest.validate(envelopes(text))).first()
    assert row["status"] == status
    assert row["http_status"] == (200 if status == ingest.OK else 400)


def test_receipt_has_counts_and_places(envelopes):
    validated = ingest.validate(envelopes(body(entry(), entry(level="critical")), body(), "x"))
    rows = {r["request_id"]: r for r in ingest.receipts(validated).collect()}
    assert rows["r0"]["accepted"] == 1 and [r["index"] for r in rows["r0"]["rejected"]] == [1]
    assert rows["r1"]["accepted"] == 0 and rows["r1"]["rejected"] == []
    assert rows["r2"]["accepted"] == 0
    summary = ingest.ingest_summary(ingest.receipts(validated)).first()
    assert tuple(summary) == (3, 2, 1, 1)


def test_normalised_row(envelopes):
    attributes = {"s": "x", "i": 3, "f": 3.0, "d": 0.1, "t": True, "n": -7, "e": ""}
    validated = ingest.validate(
        envelopes(body(entry(timestamp="2026-07-20T14:32:01.1239Z", attributes=attributes, id="mine"), entry()))
    )
    first, second = ingest.accepted(validated).orderBy(F.size("attributes").desc()).collect()
    assert first["timestamp"] == datetime(2026, 7, 20, 14, 32, 1, 123_000)
    assert first["attributes"] == {"s": "x", "i": "3", "f": "3", "d": "0.1", "t": "true", "n": "-7", "e": ""}
    assert second["attributes"] == {}
    assert first["id"] != "mine" and len(first["id"]) == 36 and first["id"] != second["id"]


def test_duplicate_key_keeps_the_last(envelopes):
    text = '{"logs":[{"timestamp":"2026-07-20T14:32:01Z","level":"nope","level":"warn","service":"a","message":"b"}]}'
    assert ingest.accepted(ingest.validate(envelopes(text))).first()["level"] == "warn"


def test_same_request_gives_the_same_ids(envelopes):
    def ids():
        return [r["id"] for r in ingest.accepted(ingest.validate(envelopes(body(entry(), entry())))).collect()]

    assert ids() == ids()


def test_redelivered_rows_merge(envelopes):
    rows = ingest.accepted(ingest.validate(envelopes(body(entry(), entry(level="warn")))))
    merged = ingest.drop_redelivered(rows.union(rows).union(rows))
    assert sorted(r["id"] for r in merged.collect()) == sorted(r["id"] for r in rows.collect())


@pytest.mark.parametrize(
    "number, text",
    [
        (0.0, "0"), (-0.0, "0"), (1.0, "1"), (-3.25, "-3.25"), (1e7, "10000000"),
        (12345678.9, "12345678.9"), (1.5e20, "150000000000000000000"), (1e21, "1e+21"),
        (-1.25e21, "-1.25e+21"), (1e-6, "0.000001"), (1.5e-6, "0.0000015"), (-2.5e-7, "-2.5e-7"),
        (0.001, "0.001"), (0.0001234, "0.0001234"),
    ],
)
def test_numbers_print_like_javascript(spark, number, text):
    row = spark.createDataFrame([(number,)], "x double").select(F.expr(number_text("x"))).first()
    assert row[0] == text


def test_queue_records(spark):
    records = spark.createDataFrame(
        [("logs", 3, 41, bytearray(body(GOOD), "utf-8"), NOW)],
        "topic string, partition int, offset long, value binary, timestamp timestamp",
    )
    found = envelopes_from_queue(records)
    assert found.first()["request_id"] == "logs-3-41"
    assert ingest.receipts(ingest.validate(found)).first()["accepted"] == 1
