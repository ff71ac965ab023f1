"""Envelope validation: request bodies in, typed entries, rejects and receipts out.

Everything about a request is worked out in the row that holds its body, with higher-order
functions over its entries. There is no shuffle between the body and the receipt. The functions
are written as SQL text, which one call hands to the parser; a stream builds them per micro-batch.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordwood.functions.ids import entry_id
from cordwood.functions.text import number_text
from cordwood.functions.times import parse_iso
from cordwood.schema import LEVELS, LOG_COLUMNS

FUTURE_ALLOWANCE = timedelta(minutes=5)

# The reason given for a time past the allowance, and the level message.
FUTURE_REASON = "timestamp cannot be more than 5 minutes in the future"
LEVEL_REASON = "Invalid option: expected one of " + "|".join(f'"{level}"' for level in LEVELS)
DATETIME_REASON = "Invalid ISO datetime"
EMPTY_REASON = "must not be empty"
ENTRY_REASON = "entry: Invalid input: expected object"

OK, NO_VALID, NOT_A_LIST = "ok", "no_valid_entries", "logs_not_a_list"
NO_LOGS, MALFORMED = "missing_logs", "malformed_json"

TEXT_FIELDS = ("timestamp", "level", "service", "message")

# Number texts up to this length have at most 15 digits, which a double keeps.
EXACT_LENGTH = 15

# Entries as read from a body: unknown keys are dropped, what is no object becomes NULL.
ENTRIES = (
    "ARRAY<STRUCT<"
    + ", ".join(f"{name}: VARIANT" for name in (*TEXT_FIELDS, "attributes"))
    + ">>"
)


def _kind(value: str) -> str:
    """JSON type of a variant; ABSENT where the key is not there."""
    return f"coalesce(schema_of_variant({value}), 'ABSENT')"


def _is_scalar(kind: str) -> str:
    """String, number or boolean; numbers appear as BIGINT, DOUBLE or DECIMAL(p,s)."""
    return f"({kind} IN ('STRING', 'BOOLEAN', 'BIGINT', 'DOUBLE') OR {kind} LIKE 'DECIMAL%')"


def _expected(field: str, what: str, kind: str) -> str:
    """Message for a field of the wrong JSON type, naming the type it had."""
    return f"""
      '{field}: Invalid input: expected {what}, received ' || CASE
        WHEN {kind} = 'ABSENT' THEN 'undefined'
        WHEN {kind} = 'VOID' THEN 'null'
        WHEN {kind} IN ('STRING', 'BOOLEAN') THEN lower({kind})
        WHEN {kind} LIKE 'ARRAY%' THEN 'array'
        WHEN {kind} LIKE 'OBJECT%' THEN 'object'
        ELSE 'number' END"""


def _read_entries() -> str:
    """Texts and JSON types of every entry's fields, and of its attributes."""
    fields = ",\n".join(
        f"'{name}', try_variant_get(e.{name}, '$', 'string'), '{name}_kind', {_kind(f'e.{name}')}"
        for name in TEXT_FIELDS
    )
    return f"""
      transform(entries, e -> named_struct(
        'is_object', e IS NOT NULL,
        {fields},
        'raw_attributes', e.attributes,
        'attributes', transform_values(
          try_variant_get(e.attributes, '$', 'map<string,variant>'),
          (k, v) -> named_struct(
            'kind', schema_of_variant(v), 'text', try_variant_get(v, '$', 'string')))))"""


def _type_entries() -> str:
    """Times parsed; attributes as text, with a count of those that are no scalars."""
    # Short numbers print as they are read, unless they are small enough for an exponent. The text
    # of any other is cast to the double that JavaScript would hold.
    as_read = (
        "a.kind IN ('STRING', 'BOOLEAN') OR (a.kind <> 'DOUBLE' "
        f"AND length(a.text) <= {EXACT_LENGTH} AND NOT contains(a.text, '0.00000'))"
    )
    # Only what the next step reads: every step copies its structs.
    kept = ", ".join(
        f"'{name}', e.{name}"
        for name in ("is_object", "timestamp_kind")
        + tuple(f"{field}{suffix}" for field in TEXT_FIELDS[1:] for suffix in ("", "_kind"))
    )
    return f"""
      transform(entries, e -> named_struct(
        {kept},
        'time', CASE WHEN e.timestamp_kind = 'STRING' THEN {parse_iso('e.timestamp')} END,
        'attributes_kind', CASE WHEN e.attributes IS NOT NULL THEN 'OBJECT'
                                ELSE {_kind('e.raw_attributes')} END,
        'bad_attributes', size(filter(map_values(e.attributes),
                                      a -> NOT {_is_scalar('a.kind')}
                                        OR a.kind = 'DOUBLE' AND a.text LIKE '%Infinity')),
        'attributes', transform_values(e.attributes, (k, a) ->
          CASE WHEN {as_read} THEN a.text
               ELSE {number_text("try_cast(a.text AS DOUBLE)")} END)))"""


def _judge_entries(require_non_empty: bool) -> str:
    """Typed entries with the reason each is refused for, NULL where it is accepted.

    The reason names every failing field, in the order the fields are declared.
    """
    levels = ", ".join(f"'{level}'" for level in LEVELS)
    allowance = int(FUTURE_ALLOWANCE.total_seconds())

    def text_issue(name: str) -> str:
        empty = f"WHEN t.{name} = '' THEN '{name}: {EMPTY_REASON}'" if require_non_empty else ""
        kind = f"t.{name}_kind"
        return f"CASE WHEN {kind} <> 'STRING' THEN {_expected(name, 'string', kind)} {empty} END"

    return f"""
      transform(entries, (t, i) -> named_struct(
        'index', i,
        'reason', CASE WHEN NOT t.is_object THEN '{ENTRY_REASON}' ELSE nullif(concat_ws(', ',
          CASE WHEN t.timestamp_kind <> 'STRING'
                 THEN {_expected('timestamp', 'string', 't.timestamp_kind')}
               WHEN t.time IS NULL THEN 'timestamp: {DATETIME_REASON}'
               WHEN t.time > received_at + INTERVAL {allowance} SECONDS
                 THEN 'timestamp: {FUTURE_REASON}' END,
          CASE WHEN t.level_kind <> 'STRING' OR t.level NOT IN ({levels})
                 THEN 'level: {LEVEL_REASON}' END,
          {text_issue('service')},
          {text_issue('message')},
          CASE WHEN t.attributes_kind NOT IN ('ABSENT', 'OBJECT')
                 THEN {_expected('attributes', 'record', 't.attributes_kind')}
               WHEN t.bad_attributes > 0 THEN 'attributes: Invalid input' END), '') END,
        'timestamp', t.time,
        'level', t.level,
        'service', t.service,
        'message', t.message,
        'attributes', t.attributes))"""


def _falsy(value: str) -> str:
    """Absent, null, false, zero or empty text."""
    kind, text = f"schema_of_variant({value})", f"try_variant_get({value}, '$', 'string')"
    return f"""(
      {value} IS NULL OR is_variant_null({value})
      OR ({kind} = 'BOOLEAN' AND {text} = 'false')
      OR ({kind} = 'STRING' AND {text} = '')
      OR ({_is_scalar(kind)} AND {kind} NOT IN ('STRING', 'BOOLEAN')
          AND try_variant_get({value}, '$', 'double') = 0))"""


def parse_envelopes(envelopes: DataFrame) -> DataFrame:
    """Bodies to ``logs`` and its ``entries``, with a flag for bodies that are not JSON.

    The JSON reader stops at the end of the first value and would overlook what follows it. So
    each body is read as the first of two elements, the second a hash of the body: where the
    second element is not that hash, the body was not exactly one value.
    """
    seal = F.hex(F.xxhash64("body"))
    sealed = F.concat(F.lit("["), F.col("body"), F.lit(',"'), seal, F.lit('"]'))
    return (
        envelopes.withColumn("doc", F.try_parse_json(sealed))
        .withColumn(
            "malformed",
            # Only objects and lists are JSON bodies.
            ~F.coalesce(
                F.col("body").rlike(r"\A\s*[\[{]")
                & (F.try_variant_get("doc", "$[1]", "string") == seal),
                F.lit(False),
            ),
        )
        .withColumns(
            {
                "logs": F.try_variant_get("doc", "$[0].logs", "variant"),
                "entries": F.try_variant_get("doc", "$[0].logs", ENTRIES),
            }
        )
        .drop("doc", "body")
    )


def validate(envelopes: DataFrame, require_non_empty: bool = True) -> DataFrame:
    """One row per request: what is wrong with the whole of it, and every entry typed and judged.

    ``require_non_empty`` refuses an empty service or message, as the documents say; without it
    any string passes.
    """
    status = f"""
      CASE WHEN malformed THEN '{MALFORMED}' WHEN {_falsy('logs')} THEN '{NO_LOGS}'
           WHEN entries IS NULL THEN '{NOT_A_LIST}' END AS failure"""
    keys = ["request_id", "received_at"]
    return (
        parse_envelopes(envelopes)
        .selectExpr(*keys, status, f"CASE WHEN NOT malformed THEN {_read_entries()} END AS entries")
        .selectExpr(*keys, "failure", f"{_type_entries()} AS entries")
        .selectExpr(*keys, "failure", f"{_judge_entries(require_non_empty)} AS entries")
    )


VALID = "filter(entries, e -> e.reason IS NULL)"
REFUSED = "filter(entries, e -> e.reason IS NOT NULL)"


def accepted(validated: DataFrame) -> DataFrame:
    """Rows for the log table; an empty map where there were no attributes."""
    # One step after the entries are rows: a stream works this out anew for every micro-batch.
    columns = {
        "id": entry_id("request_id", "index"),
        "attributes": "coalesce(attributes, CAST(map() AS MAP<STRING, STRING>))",
    }
    rows = validated.selectExpr("received_at", "request_id", f"inline({VALID})")
    return rows.selectExpr(*[f"{columns.get(name, name)} AS {name}" for name in LOG_COLUMNS], "request_id", "received_at")


def rejected(validated: DataFrame) -> DataFrame:
    """One row per refused entry."""
    return validated.selectExpr("request_id", "received_at", f"inline({REFUSED})").select(
        "request_id", "index", "reason", "received_at"
    )


def receipts(validated: DataFrame) -> DataFrame:
    """The answer to every request, the empty and the malformed ones included."""
    refused = f"transform({REFUSED}, e -> named_struct('index', e.index, 'reason', e.reason))"
    none = "CAST(array() AS ARRAY<STRUCT<index: INT, reason: STRING>>)"
    status = f"coalesce(failure, CASE WHEN accepted = 0 THEN '{NO_VALID}' ELSE '{OK}' END)"
    return validated.selectExpr(
        "request_id",
        "failure",
        f"coalesce(size({VALID}), 0) AS accepted",
        f"coalesce({refused}, {none}) AS rejected",
        "received_at",
    ).selectExpr(
        "request_id",
        f"{status} AS status",
        f"CASE WHEN {status} = '{OK}' THEN 200 ELSE 400 END AS http_status",
        "accepted",
        "rejected",
        "received_at",
    )


def ingest_summary(receipts_df: DataFrame) -> DataFrame:
    """Entries attempted, accepted and rejected over all requests."""
    refused = F.size("rejected")
    return receipts_df.agg(
        F.count(F.lit(1)).alias("requests"),
        F.coalesce(F.sum(F.col("accepted") + refused), F.lit(0)).alias("attempted"),
        F.coalesce(F.sum("accepted"), F.lit(0)).alias("accepted"),
        F.coalesce(F.sum(refused), F.lit(0)).alias("rejected"),
    )


def drop_redelivered(logs: DataFrame) -> DataFrame:
    """One row per id. Copies of an id are equal, as ids follow from request and position.

    Copies merge before the shuffle, so an id that was delivered a million times does not send a
    million rows to one task.
    """
    rest = [name for name in logs.columns if name != "id"]
    merged = logs.groupBy("id").agg(*[F.first(name).alias(name) for name in rest])
    return merged.select(*logs.columns)
