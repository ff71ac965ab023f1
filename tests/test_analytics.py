from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cordwood.operators import loadtest, reconcile
from cordwood.operators.percentile import exact_percentile
from cordwood.sources import generators
from cordwood.operators import ingest

T0 = datetime(2026, 7, 20, 14)


# --- reconciliation


def test_counts_hide_what_copies_show(logs):
    accepted = logs(("a", T0, "info", "s", "m"), ("b", T0, "info", "s", "n"))
    visible = logs(("a", T0, "info", "s", "m"), ("a", T0, "info", "s", "m"))
    by_service = reconcile.count_check(accepted, visible, ["service"]).first()
    assert by_service["consistency_passed"] and by_service["visibility_rate"] == 1.0
    copies = reconcile.copy_counts(accepted, visible)
    assert [tuple(r) for r in reconcile.missing_rows(copies).collect()] == [("b", "n", 1)]
    assert [tuple(r) for r in reconcile.surplus_rows(copies).collect()] == [("a", "m", 1)]
    assert tuple(reconcile.set_check(copies).first()) == (1, 1, False)
    assert reconcile.set_check(reconcile.copy_counts(accepted, accepted)).first()["passed"]


def test_changed_message_is_missing_and_surplus(logs):
    copies = reconcile.copy_counts(
        logs(("a", T0, "info", "s", "m")), logs(("a", T0, "info", "s", "changed"))
    )
    assert tuple(reconcile.set_check(copies).first()) == (1, 1, False)


def test_visibility(logs):
    accepted = logs(*[(f"{i}", T0, "info", "x") for i in range(3)], ("only", T0, "info", "lost"))
    visible = logs(("0", T0, "info", "x"), ("z", T0, "info", "new"))
    rows = {r["service"]: r for r in reconcile.count_check(accepted, visible, ["service"]).collect()}
    assert rows["x"]["missing_records"] == 2 and rows["x"]["visibility_rate"] == 0.3333
    assert rows["lost"]["visibility_rate"] == 0.0 and not rows["lost"]["consistency_passed"]
    assert rows["new"]["visibility_rate"] == 1.0 and rows["new"]["duplicate_records"] == 1


def test_distinct_ids(logs):
    df = logs(("a", T0), ("a", T0), ("b", T0))
    assert tuple(reconcile.distinct_ids(df).first()) == (3, 2, False)
    assert tuple(reconcile.distinct_ids(df.limit(0)).first()) == (0, 0, True)


def test_read_after_write(spark, logs):
    probes = spark.createDataFrame([("r", "p1"), ("r", "p2"), ("r", "p2"), ("q", "p3")], "run_id string, message string")
    visible = logs(
        ("1", T0, "info", reconcile.PROBE_SERVICE, "p2"), ("2", T0, "info", reconcile.PROBE_SERVICE, "p2"),
        ("3", T0, "info", "other", "p3"),
    )
    rows = reconcile.read_after_write(probes, visible, ["run_id"]).collect()
    assert {r["run_id"]: tuple(r)[1:] for r in rows} == {"r": (3, 2, 0.6667), "q": (1, 0, 0.0)}


# --- percentiles


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_percentile_equals_numpy(spark, accuracy):
    rng = np.random.default_rng(7)
    groups = {
        "one": np.array([3.5]),
        "two": np.array([1.0, 2.0]),
        "ties": np.array([5.0] * 900 + [7.0] * 100),
        "tail": rng.lognormal(3, 2, 5000),
        "negative": rng.normal(-10, 5, 777),
        None: np.array([4.0, 8.0, 9.0]),
    }
    df = spark.createDataFrame(
        [(name, float(v)) for name, values in groups.items() for v in values], "g string, v double"
    ).repartition(6)
    for fraction in (0.0, 0.5, 0.95, 1.0):
        found = {r["g"]: r["percentile"] for r in exact_percentile(df, ["g"], "v", fraction, accuracy).collect()}
        for name, values in groups.items():
            assert found[name] == pytest.approx(np.quantile(values, fraction), rel=1e-12), (name, fraction)


# --- load tests


def sample(type_="ingest", status=200, accepted=100, rejected=0, dropped=0, ms=10.0, scenario="load", phase="load"):
    return ("r", scenario, phase, type_, status, ms, accepted, rejected, dropped)


SAMPLE = (
    "run_id string, scenario string, phase string, type string, status int, duration_ms double, "
    "accepted long, rejected long, dropped long"
)


def test_rollup_tells_errors_apart(spark):
    df = spark.createDataFrame(
        [
            sample(), sample(accepted=95, rejected=5), sample(status=422, accepted=0, rejected=100),
            sample(status=503, accepted=0, rejected=100), sample(status=0, accepted=0, rejected=100),
            sample("query", 404, 0), sample("query", 500, 0),
        ],
        SAMPLE,
    )
    row = loadtest.request_rollup(df).first()
    assert (row["accepted_records"], row["rejected_records"]) == (195, 305)
    assert (row["http_errors"], row["application_errors"], row["failed_requests"]) == (3, 3, 5)


@pytest.mark.parametrize(
    "achieved, dropped, errors, p95, expected",
    [
        (1000, 0, 0.0, 100, "none"),
        (1000, 0, 0.02, 100, "service"),
        (900, 0, 0.0, 800, "service"),
        (900, 11, 0.0, 800, "generator"),
        (900, 0, 0.0, 100, "generator"),
        (1000, 11, 0.0, 100, "generator"),
        (950, 10, 0.01, 750, "none"),
    ],
)
def test_limitation(spark, achieved, dropped, errors, p95, expected):
    columns = [F.lit(x) for x in (1000, achieved, dropped, errors, p95, 500)]
    assert spark.range(1).select(loadtest.limitation(*columns)).first()[0] == expected


def test_offered_rates(spark):
    def offered(plan):
        return {r["scenario"]: (r["offered"], r["seconds"]) for r in plan.scenarios(spark).collect()}

    assert offered(loadtest.LoadPlan()) == {
        "load": (15000, 120), "stress": (24000, 150), "spike": (9750, 100), "breakpoint": (28125, 120),
    }
    quick = offered(loadtest.LoadPlan(scale=0.1, load_rate=500))
    assert quick["load"] == (500, 12) and quick["spike"] == (11591, 11)


def test_status_and_breakpoint(spark):
    steady = [sample(accepted=15000 * 30, scenario="breakpoint", phase=p) for p in ("15k",)]
    strong = [sample(accepted=22500 * 30, scenario="breakpoint", phase="22.5k")]
    slow = [sample(accepted=10, ms=9000.0, scenario="breakpoint", phase=p) for p in ("30k",)]
    df = spark.createDataFrame(steady + strong + slow, SAMPLE)
    phases = loadtest.phase_results(df).orderBy("phase_number").collect()
    assert [r["limited_by"] for r in phases] == ["none", "none", "service", "service"]
    assert [r["threshold_passed"] for r in phases] == [True, True, False, False]
    assert phases[3]["accepted_records"] == 0
    point = loadtest.breakpoints(loadtest.phase_results(df)).first()
    assert (point["sustainable_logs_per_second"], point["breaking_logs_per_second"]) == (22500, 30000)
    assert loadtest.scenario_results(df).first()["status"] == "degraded"
    dead = df.withColumns({"exit_code": F.lit(0), "recovered": F.lit(False)})
    assert loadtest.scenario_results(dead).first()["status"] == "failed"
    killed = df.withColumns({"exit_code": F.lit(2), "recovered": F.lit(True)})
    assert loadtest.scenario_results(killed).first()["status"] == "failed"


def test_generator_limited_run_completes(spark):
    row = loadtest.scenario_results(spark.createDataFrame([sample(dropped=20)], SAMPLE)).first()
    assert (row["limited_by"], row["status"], row["requests_lost"]) == ("generator", "completed", 2000)
    assert row["limit_reason"] == "Generator constraint: 20 dropped iterations, throughput=0.8/15000 logs/s"


def test_consistency_takes_either_proof(spark):
    keys = "run_id string, scenario string, "
    results = spark.createDataFrame([("r", s, 100) for s in "abcd"], keys + "accepted_records long")
    visible = spark.createDataFrame([("r", "a", 95), ("r", "b", 94), ("r", "c", 94), ("r", "d", 0)], keys + "visible_records long")
    reads = spark.createDataFrame([("r", "b", 0.8), ("r", "c", 0.79)], keys + "read_after_write_rate double")
    rows = {r["scenario"]: r for r in loadtest.consistency(results, visible, reads).collect()}
    assert {s: r["consistency_passed"] for s, r in rows.items()} == {"a": True, "b": True, "c": False, "d": True}
    assert rows["d"]["visible_records"] == 100


# --- generators


def mulberry(seed, count):
    """The published generator, step by step."""
    mask, state = 0xFFFFFFFF, seed
    for _ in range(count):
        state = (state + 0x6D2B79F5) & mask
        t = ((state ^ (state >> 15)) * (state | 1)) & mask
        t ^= (t + ((t ^ (t >> 7)) * (t | 61) & mask)) & mask
        yield ((t ^ (t >> 14)) & mask) / 4294967296


def test_seeded_logs_take_eight_draws_in_order(spark):
    draws = list(mulberry(generators.SEED, 8 * 600))
    rows = generators.seeded_logs(generators.row_numbers(spark, 600, 5), T0).orderBy("row").collect()
    for r, row in enumerate(rows):
        offset, service, level, message, region, user, duration, cached = draws[8 * r : 8 * r + 8]
        lists = generators.SEEDED
        millis = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000 - offset * 30 * generators.DAY_MS)
        assert row["timestamp"] == datetime(1970, 1, 1) + timedelta(milliseconds=millis)
        assert row["service"] == lists.services[int(service * 8)]
        assert row["level"] == lists.levels[int(level * 10)]
        assert row["message"] == f"{lists.messages[int(message * 10)]} [b{r // 500}-i{r % 500}]"
        assert row["attributes"] == {
            "user_id": str(int(user * 100000)), "region": lists.regions[int(region * 5)],
            "duration_ms": str(int(duration * 500)), "cached": str(cached > 0.5).lower(), "version": "1.0",
        }


def test_generators_do_not_depend_on_partitions(spark):
    for make in (
        lambda rows: generators.seeded_logs(rows, T0),
        generators.uniform_logs,
        lambda rows: generators.load_logs(rows, T0, "run"),
    ):
        one, many = (make(generators.row_numbers(spark, 300, n)) for n in (1, 7))
        assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
        assert one.select("id").distinct().count() == 300


def test_generated_logs_pass_validation(spark):
    logs = generators.load_logs(generators.row_numbers(spark, 250), T0, "run")
    receipts = ingest.receipts(ingest.validate(generators.as_envelopes(logs, T0, 100)))
    assert tuple(ingest.ingest_summary(receipts).first()) == (3, 250, 250, 0)
