"""Present the sample tables as logs, request bodies, request samples and probes.

Column arithmetic only, so filters and column pruning go through to the Parquet scan. Where a
log's time is the table's time cut to milliseconds, time bounds are also put on the raw column:
``cut(ts) >= bound`` and ``ts >= bound`` agree for a bound in whole milliseconds.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cordwood.functions.times import format_iso, instant, to_millis

# Clock of the sample requests: after every event, so that only the faults below are refused.
SAMPLE_NOW = datetime(2024, 2, 1)
ENTRIES_PER_REQUEST = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bounded(df: DataFrame, column: str, since: datetime | None, until: datetime | None):
    if since is not None:
        df = df.where(F.col(column) >= instant(since))
    if until is not None:
        df = df.where(F.col(column) < instant(until))
    return df


def event_columns() -> dict[str, Column]:
    level = (
        F.when(F.col("value") >= 60, "error")
        .when(F.col("value") >= 30, "warn")
        .when(F.col("value") >= 5, "info")
        .otherwise("debug")
    )
    return {
        "id": F.lpad(F.col("event_id").cast("string"), 19, "0"),
        "timestamp": to_millis(F.col("ts")),
        "level": level,
        "service": F.col("event_type"),
        "message": F.concat_ws(
            " ",
            F.col("event_type"),
            F.lit("user"),
            F.col("user_id").cast("string"),
            F.lit("value"),
            F.col("value").cast("string"),
        ),
        "attributes": F.map_concat(
            F.from_json("props", "map<string,string>"),
            F.create_map(F.lit("user_id"), F.col("user_id").cast("string")),
        ),
    }


def event_logs(
    spark: SparkSession,
    sf_dir: str,
    since: datetime | None = None,
    until: datetime | None = None,
) -> DataFrame:
    """``events`` as logs: distinct times, five services."""
    rows = _bounded(table(spark, sf_dir, "events"), "ts", since, until)
    return rows.select(*[column.alias(name) for name, column in event_columns().items()])


def order_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as logs: times are whole days, so many rows share one."""
    return table(spark, sf_dir, "orders").select(
        F.lpad(F.col("o_orderkey").cast("string"), 19, "0").alias("id"),
        F.col("o_orderdate").alias("timestamp"),
        F.when(F.col("o_orderstatus") == "F", "info")
        .when(F.col("o_orderstatus") == "O", "debug")
        .otherwise("warn")
        .alias("level"),
        F.col("o_orderpriority").alias("service"),
        F.concat_ws(
            " ", F.lit("order of customer"), F.col("o_custkey").cast("string")
        ).alias("message"),
        F.create_map(F.lit("customer"), F.col("o_custkey").cast("string")).alias("attributes"),
    )


def line_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as logs: the largest table, years of days."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws(
            "-", F.lpad(F.col("l_orderkey").cast("string"), 19, "0"),
            F.col("l_linenumber").cast("string"),
        ).alias("id"),
        F.col("l_shipdate").alias("timestamp"),
        F.when(F.col("l_returnflag") == "R", "error")
        .when(F.col("l_returnflag") == "A", "warn")
        .otherwise("info")
        .alias("level"),
        F.col("l_linestatus").alias("service"),
        F.concat_ws(" ", F.lit("part"), F.col("l_partkey").cast("string")).alias("message"),
        F.create_map(F.lit("supplier"), F.col("l_suppkey").cast("string")).alias("attributes"),
    )


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as logs, one per second: messages are the whole texts."""
    return table(spark, sf_dir, "documents").select(
        F.lpad(F.col("doc_id").cast("string"), 19, "0").alias("id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))
        .cast("timestamp_ntz")
        .alias("timestamp"),
        F.lit("info").alias("level"),
        F.col("source").alias("service"),
        F.col("text").alias("message"),
        F.create_map(F.lit("lang"), F.col("lang")).alias("attributes"),
    )


# What goes wrong with an entry, by the second of its event's clock. Every event is an entry.
FAULTS = {
    3: "level",
    7: "message_missing",
    11: "service_empty",
    17: "offset_time",
    19: "future",
    23: "nested_attribute",
    29: "attributes_null",
    31: "level_and_message",
    37: "not_an_object",
    41: "attributes_absent",
    43: "time_without_seconds",
}


def _fault(name: str) -> Column:
    seconds = [second for second, fault in FAULTS.items() if fault == name]
    return F.second("ts").isin(*seconds)


def _json_text(value: Column) -> Column:
    """A JSON string; the sample texts need no escapes."""
    return F.concat(F.lit('"'), value, F.lit('"'))


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as JSON entries, faults included, with the request and place each belongs to."""
    logs = event_columns()
    minute = F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'")
    time = (
        F.when(_fault("offset_time"), F.lit("2024-01-01T00:00:00+02:00"))
        .when(_fault("future"), F.lit("2024-02-01T00:05:00.001Z"))
        .when(_fault("time_without_seconds"), minute)
        .otherwise(format_iso(F.col("ts")))
    )
    level = F.when(
        _fault("level") | _fault("level_and_message"), F.lit("critical")
    ).otherwise(logs["level"])
    service = F.when(_fault("service_empty"), F.lit("")).otherwise(logs["service"])
    message = F.when(
        _fault("message_missing") | _fault("level_and_message"), F.lit("")
    ).otherwise(F.concat(F.lit(',"message":'), _json_text(logs["message"])))
    attributes = (
        F.when(_fault("attributes_absent"), F.lit(""))
        .when(_fault("attributes_null"), F.lit(',"attributes":null'))
        .when(_fault("nested_attribute"), F.lit(',"attributes":{"deep":{"k":1}}'))
        .otherwise(
            F.concat(
                F.lit(',"attributes":{"user_id":'),
                F.col("user_id").cast("string"),
                F.lit(',"value":'),
                F.col("value").cast("string"),
                F.lit(',"type":'),
                _json_text(F.col("event_type")),
                F.lit(',"big":'),
                (F.col("value") >= 60).cast("string"),
                F.lit("}"),
            )
        )
    )
    entry = F.concat(
        F.lit('{"timestamp":'),
        _json_text(time),
        F.lit(',"level":'),
        _json_text(level),
        F.lit(',"service":'),
        _json_text(service),
        message,
        attributes,
        F.lit(',"extra":[1,2]}'),
    )
    request = F.floor(F.col("event_id") / ENTRIES_PER_REQUEST)
    return table(spark, sf_dir, "events").select(
        request.alias("request"),
        (F.col("event_id") - request * ENTRIES_PER_REQUEST).cast("int").alias("index"),
        F.when(_fault("not_an_object"), _json_text(logs["message"])).otherwise(entry).alias("json"),
    )


def event_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies of a hundred entries each."""
    ordered = F.array_sort(F.collect_list(F.struct("index", "json")))
    return (
        event_entries(spark, sf_dir)
        .groupBy("request")
        .agg(ordered.alias("entries"))
        .select(
            F.concat(F.lit("req-"), F.col("request").cast("string")).alias("request_id"),
            F.concat(
                F.lit('{"logs":['), F.array_join(F.col("entries.json"), ","), F.lit("]}")
            ).alias("body"),
            instant(SAMPLE_NOW).alias("received_at"),
        )
    )


def order_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One body per order, in every shape a body can have; the order's priority picks the shape."""
    shape = F.substring("o_orderpriority", 1, 1)
    entry = F.concat(
        F.lit('{"timestamp":"'),
        format_iso(F.col("o_orderdate")),
        F.lit('","level":"'),
        F.when(F.col("o_orderstatus") == "P", "fatal").otherwise("info"),
        F.lit('","service":"orders","message":"order"}'),
    )
    body = (
        F.when(shape == "1", F.concat(F.lit('{"logs":['), entry))
        .when(shape == "2", F.lit('{"logs":[]}'))
        .when(shape == "3", F.concat(F.lit('{"logs":'), entry, F.lit("}")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit('{"logs":['), entry, F.lit("]} x")))
        .when(shape == "4", F.concat(F.lit('{"log":['), entry, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"logs":['), entry, F.lit("]}")))
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("request_id"),
        body.alias("body"),
        instant(SAMPLE_NOW).alias("received_at"),
    )


def lost_hours() -> Column:
    """An outage: what arrives in the first ten minutes after three is never stored."""
    return (F.hour("timestamp") == 3) & (F.minute("timestamp") < 10)


def repeated_hours() -> Column:
    """A retry storm: what arrives in the five minutes from 17:30 is stored twice."""
    return (F.hour("timestamp") == 17) & F.minute("timestamp").between(30, 34)


def visible_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of ``event_logs`` after the outage and the retries."""
    logs = event_logs(spark, sf_dir)
    copies = F.when(lost_hours(), 0).when(repeated_hours(), 2).otherwise(1)
    return logs.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies))).drop("copy")


def run_of(timestamp: Column) -> Column:
    """Test run a row belongs to: one per day."""
    return F.date_format(timestamp, "'run-'yyyyMMdd")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read-after-write probes: every signup asks for its own message."""
    logs = event_logs(spark, sf_dir).where(F.col("service") == "signup")
    return logs.select(run_of(F.col("timestamp")).alias("run_id"), "message")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the scenario, phase and type each one stands for: by date, hour and kind."""
    day, hour = F.dayofmonth("ts"), F.hour("ts")
    scenario = (
        F.when(day <= 7, "load").when(day <= 14, "stress").when(day <= 21, "spike")
        .otherwise("breakpoint")
    )
    thirds, quarters = F.floor(hour / 8).cast("int"), F.floor(hour / 6).cast("int")
    phase = (
        F.when(day <= 7, F.lit("load"))
        .when(day <= 14, F.array(*map(F.lit, ("15k", "22.5k", "30k")))[thirds])
        .when(day <= 21, F.array(*map(F.lit, ("normal", "spike", "recovery")))[thirds])
        .otherwise(F.array(*map(F.lit, ("15k", "22.5k", "30k", "45k")))[quarters])
    )
    type_ = (
        F.when(F.col("event_type") == "view", "query")
        .when(F.col("event_type") == "error", "aggregate")
        .otherwise("ingest")
    )
    events = table(spark, sf_dir, "events")
    return events.withColumns({"scenario": scenario, "phase": phase, "type": type_})


def request_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as load-test requests of one run, outcome by value."""
    value, is_ingest = F.col("value"), F.col("type") == "ingest"
    status = F.when(value >= 100, 503).when(value >= 90, 422).otherwise(200)
    refused = F.when(F.second("ts") < 2, 5).otherwise(0)
    rejected = F.when(~is_ingest, 0).when(status != 200, 100).otherwise(refused)
    return _requests(spark, sf_dir).select(
        F.lit("run-1").alias("run_id"),
        "scenario",
        "phase",
        "type",
        status.alias("status"),
        (value * 10).alias("duration_ms"),
        F.when(is_ingest, 100 - rejected).otherwise(0).cast("bigint").alias("accepted"),
        rejected.cast("bigint").alias("rejected"),
        F.when(value >= 140, 1).otherwise(0).cast("bigint").alias("dropped"),
    )


# What becomes of the requests of a user's run, by the number of the user.
RUNS = ("held", "starved", "slow", "stuck", "crashed", "fading", "erring", "failing")
# Records of a request that lets its phase reach any target.
AMPLE = 10_000_000


def run_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as load-test requests of eight runs, one for each way in which a run can end."""
    run = F.element_at(F.array(*map(F.lit, RUNS)), (F.col("user_id") % len(RUNS) + 1).cast("int"))
    is_ingest, of = F.col("type") == "ingest", F.col("run_id")
    late = F.col("phase").isin("30k", "45k", "spike", "recovery")
    lost = ((of == "erring") & (F.col("event_id") % 14 == 0)) | ((of == "failing") & (F.col("event_id") % 4 == 0))
    meagre = of.isin("starved", "slow", "erring", "failing") | ((of == "fading") & late)
    return _requests(spark, sf_dir).withColumn("run_id", run).select(
        "run_id",
        "scenario",
        "phase",
        "type",
        F.when(lost, 503).otherwise(200).alias("status"),
        (F.col("value") * F.when(of.isin("slow", "fading"), 1000).otherwise(1)).alias("duration_ms"),
        F.when(~is_ingest | lost, 0).when(meagre, 1).otherwise(AMPLE).cast("bigint").alias("accepted"),
        F.lit(0).cast("bigint").alias("rejected"),
        F.when(of == "starved", 1).otherwise(0).cast("bigint").alias("dropped"),
        F.when(of == "crashed", 2).otherwise(0).alias("exit_code"),
        (of != "stuck").alias("recovered"),
    )


def quarter_hour(timestamp: Column) -> Column:
    """Test run a row belongs to if each quarter of an hour of the day is one."""
    return F.concat(F.date_format(timestamp, "'slot-'HH"), F.floor(F.minute(timestamp) / 15).cast("string"))
