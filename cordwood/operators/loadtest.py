"""Load-test analytics over a table of request samples.

A sample is one request: run_id, scenario, phase, type, status, duration_ms, accepted, rejected,
dropped. Samples may be any number; everything after the first grouping is one row per run and
scenario or phase.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordwood.operators.percentile import exact_percentile, small_side

# Offered logs per second and seconds of each phase, in order.
PHASES = {
    "load": [("load", 15000, 120)],
    "stress": [("15k", 15000, 30), ("22.5k", 22500, 60), ("30k", 30000, 60)],
    "spike": [("normal", 7500, 30), ("spike", 30000, 10), ("recovery", 7500, 60)],
    "breakpoint": [("15k", 15000, 30), ("22.5k", 22500, 30), ("30k", 30000, 30), ("45k", 45000, 30)],
}
# Expected ingest latency in milliseconds per scenario.
LATENCY_MS = {"load": 500, "stress": 1000, "spike": 5000, "breakpoint": 5000}
# Logs per request, and the limits of the classifications below.
BATCH_SIZE = 100
RATE_SHARE = 0.95
DROPPED_ALLOWED = 10
ERROR_SHARE = 0.01
LATENCY_FACTOR = 1.5
THRESHOLD_ERRORS = 0.05
FAILED_ERRORS = 0.1
VISIBLE_SHARE = 0.95
READ_SHARE = 0.8

SCENARIO_KEYS = ("run_id", "scenario")
PHASE_KEYS = ("run_id", "scenario", "phase")


def _per_second(count: Column, seconds: Column) -> Column:
    return count / F.greatest(F.lit(1), seconds)


@dataclass(frozen=True)
class LoadPlan:
    """The planned phases, shortened by ``scale``; ``load_rate`` is what the load scenario offers."""

    scale: float = 1.0
    load_rate: int = 15000

    def phases(self, spark: SparkSession) -> DataFrame:
        """Eleven rows; as their number is fixed above, they are always broadcast."""
        rows = [
            F.struct(
                F.lit(scenario).alias("scenario"),
                F.lit(number).alias("phase_number"),
                F.lit(phase).alias("phase"),
                F.lit(self.load_rate if scenario == "load" else target).alias("target"),
                F.lit(max(2, math.floor(seconds * self.scale + 0.5))).alias("seconds"),
                F.lit(LATENCY_MS[scenario]).alias("latency_limit"),
            )
            for scenario, phases in PHASES.items()
            for number, (phase, target, seconds) in enumerate(phases)
        ]
        return spark.range(1).select(F.inline(F.array(*rows)))

    def scenarios(self, spark: SparkSession) -> DataFrame:
        return (
            self.phases(spark)
            .groupBy("scenario")
            .agg(
                F.sum("seconds").alias("seconds"),
                weighted_mean(F.col("target"), F.col("seconds")).alias("offered"),
                F.max("latency_limit").alias("latency_limit"),
            )
        )


def weighted_mean(rate: Column, seconds: Column) -> Column:
    """Rate averaged over time, to whole units."""
    return F.round(F.sum(rate * seconds) / F.sum(seconds)).cast("bigint")


TOTALS = (
    "requests",
    "accepted_records",
    "rejected_records",
    "http_errors",
    "application_errors",
    "failed_requests",
    "dropped_iterations",
)


def request_rollup(samples: DataFrame, keys: Sequence[str] = PHASE_KEYS) -> DataFrame:
    """Totals per key: requests, records, and errors by who is to blame for them.

    ``exit_code`` and ``recovered`` may come with the samples; without them the generator is taken
    to have ended well and the service to have come back.
    """
    status = F.col("status")
    http_error = (status == 0) | (status >= 500)
    partly_refused = (F.col("type") == "ingest") & (status == 200) & (F.col("rejected") > 0)
    application_error = (~http_error & (status != 200)) | partly_refused
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("accepted").alias("accepted_records"),
        F.sum("rejected").alias("rejected_records"),
        F.count_if(http_error).alias("http_errors"),
        F.count_if(application_error).alias("application_errors"),
        F.count_if(~status.between(200, 399)).alias("failed_requests"),
        F.sum("dropped").alias("dropped_iterations"),
        *[
            (f(name) if name in samples.columns else F.lit(default)).alias(name)
            for name, f, default in (("exit_code", F.max, 0), ("recovered", F.min, True))
        ],
    )


def scenario_totals(rollup: DataFrame) -> DataFrame:
    """A rollup by phase folded to scenarios."""
    return rollup.groupBy(*SCENARIO_KEYS).agg(
        *[F.sum(name).alias(name) for name in TOTALS],
        F.max("exit_code").alias("exit_code"),
        F.min("recovered").alias("recovered"),
    )


def latency_p95(samples: DataFrame, keys: Sequence[str] = SCENARIO_KEYS) -> DataFrame:
    """95th percentile of each request type, side by side; 0 where a type had no request."""
    by_type = exact_percentile(samples, [*keys, "type"], "duration_ms", 0.95)

    def of(type_: str) -> Column:
        value = F.max(F.when(F.col("type") == type_, F.col("percentile")))
        return F.round(F.coalesce(value, F.lit(0.0)), 4)

    return by_type.groupBy(*keys).agg(
        of("ingest").alias("latency_p95_ms"),
        of("query").alias("query_p95_ms"),
        of("aggregate").alias("aggregate_p95_ms"),
    )


def approximate_p95(samples: DataFrame, keys: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """95th percentile per key in one pass, within 1/accuracy of the rank."""
    return samples.groupBy(*keys).agg(
        F.percentile_approx("duration_ms", 0.95, accuracy).alias("p95_ms")
    )


def throughput(rollup: DataFrame, plan: LoadPlan = LoadPlan()) -> DataFrame:
    """Per scenario of a rollup: achieved rate from accepted records, error shares, requests lost.

    The offered rate stands beside the achieved one and never in its place.
    """
    totals = scenario_totals(rollup)
    scenarios = plan.scenarios(rollup.sparkSession)
    requests = F.col("requests")
    return totals.join(F.broadcast(scenarios), "scenario", "left").select(
        *SCENARIO_KEYS,
        F.col("offered").alias("offered_logs_per_second"),
        F.round(_per_second(F.col("accepted_records"), F.col("seconds")), 4).alias(
            "logs_per_second"
        ),
        "accepted_records",
        "rejected_records",
        "dropped_iterations",
        (F.col("failed_requests") / requests).alias("error_rate"),
        (F.col("http_errors") / requests).alias("http_error_rate"),
        (F.col("application_errors") / requests).alias("application_error_rate"),
        (F.col("rejected_records") + F.col("dropped_iterations") * BATCH_SIZE).alias(
            "requests_lost"
        ),
        "latency_limit",
        "exit_code",
        "recovered",
    )


def limitation(
    target: Column,
    achieved: Column,
    dropped: Column,
    error_rate: Column,
    p95: Column,
    latency_limit: Column,
) -> Column:
    """``service``, ``generator`` or ``none``: which side kept a run below its target."""
    share = F.when(target > 0, achieved / target).otherwise(1.0)
    slow = share < RATE_SHARE
    spiked = p95 > latency_limit * LATENCY_FACTOR
    drops = dropped > DROPPED_ALLOWED
    # Past the first case the service has no errors to speak of, so a low rate without a latency
    # spike is the generator's, whether or not it ran out of workers.
    return (
        F.when((error_rate > ERROR_SHARE) | (slow & spiked & ~drops), "service")
        .when(drops | slow, "generator")
        .otherwise("none")
    )


def limitation_reason(
    limited_by: Column,
    target: Column,
    achieved: Column,
    dropped: Column,
    error_rate: Column,
    p95: Column,
) -> Column:
    """What the classification rests on, in words."""
    # The three texts.
    service = "Service degradation: errorRate=%.2f%%, p95=%.2fms"
    generator = "Generator constraint: %d dropped iterations, throughput=%.1f/%d logs/s"
    nominal = "Nominal performance within target thresholds"
    return (
        F.when(limited_by == "service", F.format_string(service, error_rate * 100, p95))
        .when(limited_by == "generator", F.format_string(generator, dropped, achieved, target))
        .otherwise(nominal)
    )


def scenario_results(
    samples: DataFrame, rollup: DataFrame | None = None, plan: LoadPlan = LoadPlan()
) -> DataFrame:
    """Per scenario: rates, latencies, who limited it, whether it held its threshold, its status.

    ``rollup`` is ``request_rollup`` of the samples where the caller has it already.
    """
    totals = throughput(request_rollup(samples) if rollup is None else rollup, plan)
    base = totals.join(latency_p95(samples), list(SCENARIO_KEYS))
    offered, achieved = F.col("offered_logs_per_second"), F.col("logs_per_second")
    errors = F.col("error_rate")
    limited = limitation(
        offered,
        achieved,
        F.col("dropped_iterations"),
        errors,
        F.col("latency_p95_ms"),
        F.col("latency_limit"),
    )
    by_generator = F.col("limited_by") == "generator"
    passed = ((achieved >= offered * RATE_SHARE) | by_generator) & (errors <= THRESHOLD_ERRORS)
    awaits_recovery = F.col("scenario").isin("spike", "breakpoint")
    status = (
        F.when(awaits_recovery & ~F.col("recovered"), "failed")
        .when(F.col("exit_code") > 1, "failed")
        .when(F.col("threshold_passed") | by_generator, "completed")
        .when(errors > FAILED_ERRORS, "failed")
        .otherwise("degraded")
    )
    return (
        base.withColumn("limited_by", limited)
        .withColumn(
            "limit_reason",
            limitation_reason(
                F.col("limited_by"),
                offered,
                achieved,
                F.col("dropped_iterations"),
                errors,
                F.col("latency_p95_ms"),
            ),
        )
        .withColumn("threshold_passed", passed)
        .withColumn("status", status)
    )


def phase_results(samples: DataFrame, plan: LoadPlan = LoadPlan()) -> DataFrame:
    """Per planned phase of every scenario that ran; a phase without samples achieved nothing."""
    # Written once: the samples are not read again for the phases.
    rollup = small_side(request_rollup(samples))
    scenarios = scenario_results(samples, rollup, plan).select(
        *SCENARIO_KEYS, "dropped_iterations", "error_rate", "latency_p95_ms"
    )
    planned = scenarios.join(F.broadcast(plan.phases(samples.sparkSession)), "scenario")
    accepted = rollup.select(*PHASE_KEYS, "accepted_records")
    achieved = _per_second(F.col("accepted_records"), F.col("seconds"))
    limited = limitation(
        F.col("target"),
        achieved,
        F.col("dropped_iterations"),
        F.col("error_rate"),
        F.col("latency_p95_ms"),
        F.col("latency_limit"),
    )
    return (
        planned.join(accepted, list(PHASE_KEYS), "left")
        .fillna({"accepted_records": 0})
        .select(
            *PHASE_KEYS,
            "phase_number",
            F.col("target").alias("target_logs_per_second"),
            "seconds",
            "accepted_records",
            F.round(achieved, 4).alias("achieved_logs_per_second"),
            limited.alias("limited_by"),
            (
                (achieved >= F.col("target") * RATE_SHARE) | (limited == "generator")
            ).alias("threshold_passed"),
        )
    )


def breakpoints(phases: DataFrame) -> DataFrame:
    """Per scenario: target of the last phase that held, and of the first that did not."""
    by_service = F.col("limited_by") == "service"
    held = F.col("threshold_passed") & ~by_service
    target, number = F.col("target_logs_per_second"), F.col("phase_number")
    return phases.groupBy(*SCENARIO_KEYS).agg(
        F.max_by(F.when(held, target), F.when(held, number)).alias("sustainable_logs_per_second"),
        F.min_by(F.when(~held, target), F.when(~held, number)).alias("breaking_logs_per_second"),
    )


def achieved_rate(phases: DataFrame) -> DataFrame:
    """Per scenario: achieved rate of the phases weighted by their length."""
    return phases.groupBy(*SCENARIO_KEYS).agg(
        weighted_mean(F.col("achieved_logs_per_second"), F.col("seconds")).alias("mean_rate")
    )


def consistency(results: DataFrame, visible: DataFrame, reads: DataFrame) -> DataFrame:
    """Per scenario: most accepted records are visible, or most probes read back.

    ``visible`` holds visible_records and ``reads`` read_after_write_rate, both by scenario keys.
    A visible count of zero says that the drain was not observed; then the accepted count stands.
    """
    keys = list(SCENARIO_KEYS)
    accepted = F.col("accepted_records")
    drained = F.nullif(F.coalesce("visible_records", F.lit(0)), F.lit(0))
    joined = reduce(
        lambda left, right: left.join(right, keys, "left"),
        [visible, reads],
        results.select(*keys, "accepted_records"),
    )
    rate = F.coalesce("read_after_write_rate", F.lit(0.0))
    return joined.select(
        *keys,
        "accepted_records",
        F.coalesce(drained, accepted).alias("visible_records"),
        rate.alias("read_after_write_rate"),
        (
            (F.coalesce(drained, accepted) >= accepted * VISIBLE_SHARE) | (rate >= READ_SHARE)
        ).alias("consistency_passed"),
    )
