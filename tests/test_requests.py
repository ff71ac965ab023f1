"""The contract checks of the service, run against a store."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest

from cordwood.plans import requests
from cordwood.plans.params import QueryError
from cordwood.sources.log_table import LogStore

NOW = datetime(2026, 7, 20, 15)


def iso(ts):
    return ts.isoformat(timespec="milliseconds") + "Z"


def entry(service, ago=0.0, **changes):
    plain = {
        "timestamp": iso(NOW - timedelta(seconds=ago)),
        "level": "info",
        "service": service,
        "message": "parcel scanned",
        "attributes": {"depot": "north", "weight": 2, "fragile": False},
    }
    return {**plain, **changes}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    store = LogStore(spark, str(tmp_path_factory.mktemp("store")))
    batches = {
        "belt": [
            entry("belt", level=level, message=f"parcel {level}")
            for level in ("debug", "info", "warn", "error")
        ],
        "half": [entry("half", level="fatal"), entry("half"), entry("half", message="")],
        "dock": [entry("dock", 90, message="loaded"), entry("dock", 4000)],
        "gate": [entry("gate", i) for i in range(7)],
        "lift": [entry("lift", level="warn"), entry("lift")],
        "truck": [entry("truck", s, attributes={"plate": "k"}) for s in (120, 120, 30)],
        "scale": [entry("scale", 5, level=level) for level in ("debug", "warn", "debug")],
    }
    bodies = {name: json.dumps({"logs": logs}) for name, logs in batches.items()}
    bodies |= {"none": '{"logs":[]}', "cut": '{"logs":['}
    store.answers = requests.post_logs(store, bodies, NOW, "first")
    return store


def test_post(store):
    answers = store.answers
    assert answers["belt"] == {"status": 200, "accepted": 4, "rejected": []}
    assert answers["half"]["accepted"] == 1
    assert [r["index"] for r in answers["half"]["rejected"]] == [0, 2]
    assert answers["none"]["status"] == answers["cut"]["status"] == 400


def test_all_of_a_request_can_be_read(store):
    logs = requests.get_logs(store, {"service": "belt"})["logs"]
    assert {log["message"] for log in logs} == {f"parcel {x}" for x in ("debug", "info", "warn", "error")}
    assert len({log["id"] for log in logs}) == 4
    assert logs[0]["attributes"] == {"depot": "north", "weight": "2", "fragile": "false"}


def test_other_requests_under_one_batch_name_are_all_kept(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    for name in ("r1", "r2", "r1"):
        answer = requests.post_logs(store, {name: json.dumps({"logs": [entry(name)]})}, NOW, "same")
        assert answer[name]["status"] == 200
    assert sorted(log["service"] for log in requests.get_logs(store, {})["logs"]) == ["r1", "r2"]


def test_times(store):
    around = {"since": iso(NOW - timedelta(seconds=95)), "until": iso(NOW - timedelta(seconds=85))}
    logs = requests.get_logs(store, {"service": "dock", **around})["logs"]
    assert [log["message"] for log in logs] == ["loaded"]
    assert logs[0]["timestamp"] == "2026-07-20T14:58:30.000Z"


def test_limit_and_cursor(store):
    assert len(requests.get_logs(store, {"service": "gate", "limit": "4"})["logs"]) == 4
    pages = list(requests.pages(store, {"service": "gate", "limit": "3"}))
    assert [len(page) for page in pages] == [3, 3, 1]
    assert len({log["id"] for page in pages for log in page}) == 7


def test_filters(store):
    assert [log["level"] for log in requests.get_logs(store, {"service": "lift", "level": "warn"})["logs"]] == ["warn"]
    with pytest.raises(QueryError):
        requests.get_logs(store, {"level": "critical"})


HOUR = {"since": iso(NOW - timedelta(hours=1)), "until": iso(NOW + timedelta(minutes=1))}


def test_buckets(store):
    found = list(requests.get_aggregate(store, {**HOUR, "bucket": "1m", "attr.plate": "k"}))
    assert found == [
        {"start": "2026-07-20T14:58:00.000Z", "group": None, "count": 2},
        {"start": "2026-07-20T14:59:00.000Z", "group": None, "count": 1},
    ]


def test_groups(store):
    found = requests.get_aggregate(store, {**HOUR, "bucket": "1h", "service": "scale", "group_by": "level"})
    assert {row["group"]: row["count"] for row in found} == {"debug": 2, "warn": 1}


def test_bulk_load_keeps_the_rollup_in_step(store, logs):
    store.load(logs(*[(f"x{i}", NOW + timedelta(days=400, seconds=i), "warn", "bulk") for i in range(90)]), "bulk")
    span = {"since": iso(NOW + timedelta(days=399)), "until": iso(NOW + timedelta(days=401))}
    found = list(requests.get_aggregate(store, {**span, "bucket": "1m"}))
    assert [row["count"] for row in found] == [60, 30]
    store.expire(NOW + timedelta(days=500))
    assert store.logs.days() == store.rollup.days() == []
