"""Synthetic logs by row number.

Every profile takes a DataFrame with a row number and returns one log per row. A row's content
depends on its number and the seed alone, so any partitioning gives the same logs.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordwood.functions.draws import pick, with_draws
from cordwood.functions.ids import uuid_shape
from cordwood.functions.times import format_iso, instant

DAY_MS = 24 * 60 * 60 * 1000


@dataclass(frozen=True)
class Profile:
    services: tuple[str, ...]
    levels: tuple[str, ...]
    regions: tuple[str, ...]
    messages: tuple[str, ...]


# Word lists of the seeded profile; repeated levels are weights.
SEEDED = Profile(
    services=(
        "checkout", "payment", "auth", "order", "inventory", "gateway", "notification", "analytics",
    ),
    levels=("info",) * 5 + ("debug",) * 2 + ("warn",) * 2 + ("error",),
    regions=("us-east", "us-west", "eu-west", "eu-central", "ap-southeast"),
    messages=(
        "Request completed successfully",
        "Database query took 12ms",
        "Payment processed for user",
        "Cache miss on key lookup",
        "User logged in from new device",
        "Inventory reservation completed",
        "Notification queued for delivery",
        "Failed to connect to upstream service",
        "Rate limit threshold approaching",
        "Token refreshed successfully",
    ),
)

# Word lists of the uniform profile.
UNIFORM = Profile(
    services=("api", "auth", "checkout", "payments", "orders", "users"),
    levels=("debug", "info", "warn", "error"),
    regions=("eu-west", "us-east", "ap-south", "eu-central"),
    messages=(
        "request completed",
        "request failed",
        "user authenticated",
        "payment processed",
        "payment declined",
        "order created",
        "database query completed",
        "cache miss",
        "cache hit",
        "connection timeout",
    ),
)
# The time range of the uniform profile.
UNIFORM_START = datetime(2026, 7, 1)
UNIFORM_END = datetime(2026, 7, 31)

# Word lists of the load shape.
LOAD = Profile(
    services=("checkout", "payments", "auth", "orders", "users", "api"),
    levels=("debug", "info", "warn", "error"),
    regions=("eu-west", "us-east", "us-west", "ap-south", "eu-central"),
    messages=(
        "payment declined",
        "payment processed",
        "order created",
        "user authenticated",
        "database query completed",
        "cache hit",
        "request completed",
        "connection pool acquired",
        "token verification succeeded",
        "session refreshed",
    ),
)

SEED = 1337
SEED_BATCH = 500
LOAD_BATCH = 100


def row_numbers(spark: SparkSession, count: int, partitions: int | None = None) -> DataFrame:
    return spark.range(0, count, 1, partitions).withColumnRenamed("id", "row")


def _millis(ts: datetime) -> int:
    return round(ts.replace(tzinfo=timezone.utc).timestamp() * 1000)


def _time(millis: Column) -> Column:
    return F.timestamp_millis(millis.cast("bigint")).cast("timestamp_ntz")


def _below(uniform: Column, bound: int) -> Column:
    return F.floor(uniform * bound).cast("bigint")


def _row_id(kind: str, seed: int) -> Column:
    name = F.concat_ws(":", F.lit(kind), F.lit(str(seed)), F.col("row").cast("string"))
    return uuid_shape(F.sha2(name, 256))


def seeded_logs(rows: DataFrame, now: datetime, seed: int = SEED, days: int = 30) -> DataFrame:
    """Logs spread evenly over the days before ``now``, with weighted levels."""
    draws = ("offset", "service", "level", "message", "region", "user", "duration", "cached")
    drawn = with_draws(rows, seed, F.col("row"), draws)
    batch = F.floor(F.col("row") / SEED_BATCH)
    place = F.concat(
        F.lit(" [b"), batch.cast("string"), F.lit("-i"),
        (F.col("row") - batch * SEED_BATCH).cast("string"), F.lit("]"),
    )
    return drawn.select(
        "row",
        _row_id("seeded", seed).alias("id"),
        # A fraction of a millisecond is cut from the result, not from the offset.
        _time(F.floor(F.lit(float(_millis(now))) - F.col("offset") * float(days * DAY_MS))).alias(
            "timestamp"
        ),
        pick(SEEDED.levels, F.col("level")).alias("level"),
        pick(SEEDED.services, F.col("service")).alias("service"),
        F.concat(pick(SEEDED.messages, F.col("message")), place).alias("message"),
        F.create_map(
            F.lit("user_id"), _below(F.col("user"), 100_000).cast("string"),
            F.lit("region"), pick(SEEDED.regions, F.col("region")),
            F.lit("duration_ms"), _below(F.col("duration"), 500).cast("string"),
            F.lit("cached"), (F.col("cached") > 0.5).cast("string"),
            F.lit("version"), F.lit("1.0"),
        ).alias("attributes"),
    )


def uniform_logs(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Logs spread evenly over a fixed month, all choices equally likely."""
    draws = ("service", "level", "offset", "message", "user", "region", "retries")
    drawn = with_draws(rows, seed, F.col("row"), draws)
    start, end = _millis(UNIFORM_START), _millis(UNIFORM_END)
    return drawn.select(
        "row",
        _row_id("uniform", seed).alias("id"),
        _time(F.floor(F.lit(float(start)) + F.col("offset") * float(end - start))).alias("timestamp"),
        pick(UNIFORM.levels, F.col("level")).alias("level"),
        pick(UNIFORM.services, F.col("service")).alias("service"),
        pick(UNIFORM.messages, F.col("message")).alias("message"),
        F.create_map(
            F.lit("user_id"), _below(F.col("user"), 100_000).cast("string"),
            F.lit("request_id"), _row_id("request", seed),
            F.lit("region"), pick(UNIFORM.regions, F.col("region")),
            F.lit("retries"), _below(F.col("retries"), 4).cast("string"),
        ).alias("attributes"),
    )


def load_logs(
    rows: DataFrame,
    now: datetime,
    run_id: str,
    seed: int = SEED,
    batch: int = LOAD_BATCH,
    workers: int = 1,
) -> DataFrame:
    """Batches as load workers send them in turn: ten milliseconds between a batch's entries."""
    number = F.floor(F.col("row") / batch)
    worker = (number % workers + 1).cast("bigint")
    place = (F.col("row") - number * batch).cast("int")
    drawn = with_draws(rows, seed, F.col("row"), ("level", "service"))

    def cycle(choices: tuple[str, ...], shift: Column | None = None) -> Column:
        position = place if shift is None else place + F.floor(shift * len(choices)).cast("int")
        return F.array(*[F.lit(c) for c in choices])[position % len(choices)]

    mark = F.concat(
        F.lit(" [vu="), worker.cast("string"),
        F.lit(" iter="), F.floor(number / workers).cast("string"),
        F.lit(" i="), place.cast("string"), F.lit("]"),
    )
    return drawn.select(
        "row",
        _row_id(run_id, seed).alias("id"),
        _time(F.lit(_millis(now)) - place * 10).alias("timestamp"),
        cycle(LOAD.levels, F.col("level")).alias("level"),
        cycle(LOAD.services, F.col("service")).alias("service"),
        F.concat(cycle(LOAD.messages), mark).alias("message"),
        F.create_map(
            F.lit("user_id"), ((worker * 10_000 + place) % 100_000).cast("string"),
            F.lit("region"), cycle(LOAD.regions),
            F.lit("retries"), (place % 4).cast("string"),
            F.lit("run_id"), F.lit(run_id),
        ).alias("attributes"),
    )


def as_envelopes(logs: DataFrame, received_at: datetime, batch: int) -> DataFrame:
    """Generated logs as request bodies of ``batch`` entries, by row number."""
    entry = F.to_json(
        F.struct(
            format_iso(F.col("timestamp")).alias("timestamp"),
            "level", "service", "message", "attributes",
        )
    )
    return (
        logs.select("row", F.floor(F.col("row") / batch).alias("request"), entry.alias("json"))
        .groupBy("request")
        .agg(F.array_sort(F.collect_list(F.struct("row", "json"))).alias("entries"))
        .select(
            F.col("request").cast("string").alias("request_id"),
            F.concat(
                F.lit('{"logs":['), F.array_join(F.col("entries.json"), ","), F.lit("]}")
            ).alias("body"),
            instant(received_at).alias("received_at"),
        )
    )
