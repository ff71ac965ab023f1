"""Probes answered by a stream of logs."""

from __future__ import annotations

from datetime import datetime, timedelta

from cordwood.streaming import probes

START = datetime(2024, 1, 10, 8)
PROBES = "probe_id string, run_id string, message string, sent_at timestamp_ntz"
LOGS = "message string, seen_at timestamp_ntz"


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_probes_are_answered_in_time_or_given_up(spark, tmp_path):
    sent, seen = str(tmp_path / "probes"), str(tmp_path / "logs")
    steps = [
        ([("p0", "r", "m0", at(0)), ("p1", "r", "m1", at(1)), ("p2", "s", "m2", at(2))], [("m0", at(5)), ("m0", at(9)), ("m1", at(0))]),
        ([("p3", "r", "m3", at(40))], [("m2", at(33)), ("m3", at(40))]),  # m2 a second too late
        ([("p4", "s", "m4", at(100))], [("other", at(100))]),
        ([("last", "end", "none", at(1000))], [("none", at(1000))]),
    ]
    table = probes.outcome_table(spark, str(tmp_path / "outcomes"))
    settled = []
    for own, logs in steps:
        spark.createDataFrame(own, PROBES).coalesce(1).write.mode("append").parquet(sent)
        spark.createDataFrame(logs, LOGS).coalesce(1).write.mode("append").parquet(seen)
        outcomes = probes.probe_outcomes(
            spark.readStream.schema(PROBES).parquet(sent), spark.readStream.schema(LOGS).parquet(seen)
        )
        probes.start_outcomes(outcomes, table, str(tmp_path / "progress")).awaitTermination()
        settled.append({r["probe_id"] for r in table.read().select("probe_id").collect()})
    # A stop after every step: the answered are known at once, the others once their time is over.
    assert settled[0] == {"p0"} and "p3" in settled[1] and {"p1", "p2"} <= settled[2] and "p4" in settled[3]
    rates = {r["run_id"]: tuple(r)[1:] for r in probes.answered_rates(table.read()).collect()}
    assert rates["r"] == (3, 2, 0.6667, 5000.0)
    assert rates["s"] == (2, 0, 0.0, None)
