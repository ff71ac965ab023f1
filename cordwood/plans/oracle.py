"""Plain SQL for the registered queries, to be run by another engine on the same tables.

Written from the rules, not from the Spark code: the ingest statements, for one, never parse a
body but state which rows the faults in it must refuse.
"""

from __future__ import annotations

from cordwood.sources.generators import LOAD, SEEDED, UNIFORM

# Fixed values, stated here once more so that a wrong one elsewhere is seen: target rate and seconds
# of each phase, and the latency that each scenario allows.
PHASES = {
    "load": [("load", 15000, 120)],
    "stress": [("15k", 15000, 30), ("22.5k", 22500, 60), ("30k", 30000, 60)],
    "spike": [("normal", 7500, 30), ("spike", 30000, 10), ("recovery", 7500, 60)],
    "breakpoint": [("15k", 15000, 30), ("22.5k", 22500, 30), ("30k", 30000, 30), ("45k", 45000, 30)],
}
LATENCY_MS = {"load": 500, "stress": 1000, "spike": 5000, "breakpoint": 5000}

EVENT_LOGS = """
event_logs AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 19, '0') AS id,
         date_trunc('millisecond', ts) AS timestamp,
         CASE WHEN value >= 60 THEN 'error' WHEN value >= 30 THEN 'warn'
              WHEN value >= 5 THEN 'info' ELSE 'debug' END AS level,
         event_type AS service,
         event_type || ' user ' || CAST(user_id AS VARCHAR) || ' value '
           || CAST(value AS VARCHAR) AS message,
         json_extract_string(props, '$.k') AS attr_k,
         CAST(user_id AS VARCHAR) AS attr_user_id
  FROM events)
"""

ORDER_LOGS = """
order_logs AS (
  SELECT lpad(CAST(o_orderkey AS VARCHAR), 19, '0') AS id,
         o_orderdate AS timestamp,
         CASE o_orderstatus WHEN 'F' THEN 'info' WHEN 'O' THEN 'debug' ELSE 'warn' END AS level,
         o_orderpriority AS service,
         'order of customer ' || CAST(o_custkey AS VARCHAR) AS message,
         CAST(o_custkey AS VARCHAR) AS attr_customer
  FROM orders)
"""

DOCUMENT_LOGS = """
document_logs AS (
  SELECT lpad(CAST(doc_id AS VARCHAR), 19, '0') AS id,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS timestamp,
         'info' AS level, source AS service, text AS message, lang AS attr_lang
  FROM documents)
"""

LINE_LOGS = """
line_logs AS (
  SELECT l_shipdate AS timestamp,
         CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warn' ELSE 'info' END AS level
  FROM lineitem)
"""

ISO = "strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%gZ')"


def _ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in parts) + "\n"


def _list(source: str, attributes: str, where: str = "true", limit: int = 100, skip: int = 0) -> str:
    ctes = {"event_logs": EVENT_LOGS, "order_logs": ORDER_LOGS, "document_logs": DOCUMENT_LOGS}
    return (
        _ctes(ctes[source])
        + f"SELECT id, {ISO} AS timestamp, level, service, message, {attributes} FROM ("
        + f"SELECT * FROM {source} WHERE {where} "
        + f"ORDER BY timestamp DESC, id DESC LIMIT {limit} OFFSET {skip})"
    )


def _list_events(where: str = "true", limit: int = 100) -> str:
    return _list("event_logs", "attr_k, attr_user_id", where, limit)


FLOORS = {
    "1m": "date_trunc('minute', timestamp)",
    "5m": "time_bucket(INTERVAL 5 MINUTE, timestamp)",
    "1h": "date_trunc('hour', timestamp)",
    "1d": "date_trunc('day', timestamp)",
}


def _count(bucket: str, group: str | None = None, where: str = "true", source: str = "event_logs"):
    ctes = {"event_logs": EVENT_LOGS, "order_logs": ORDER_LOGS, "line_logs": LINE_LOGS}
    group_column = group or "CAST(NULL AS VARCHAR)"
    return (
        _ctes(ctes[source])
        + f'SELECT CAST({FLOORS[bucket]} AS TIMESTAMP) AS start, {group_column} AS "group", '
        + f'count(*) AS count FROM {source} WHERE {where} GROUP BY 1, 2'
    )


def _pages(source: str, limit: int) -> str:
    ctes = {"event_logs": EVENT_LOGS, "order_logs": ORDER_LOGS}
    return (
        _ctes(
            ctes[source],
            f"""
placed AS (
  SELECT id, {ISO} AS iso,
         row_number() OVER (ORDER BY timestamp DESC, id DESC) - 1 AS position
  FROM {source})
""",
        )
        + f"""
SELECT position // {limit} AS page, count(*) AS rows,
       arg_min(iso, position) AS first_timestamp, arg_min(id, position) AS first_id,
       arg_max(iso, position) AS last_timestamp, arg_max(id, position) AS last_id
FROM placed GROUP BY 1
"""
    )


# --- ingest: the truth from the fault table ------------------------------------------------------

LEVEL_REASON = 'level: Invalid option: expected one of "debug"|"info"|"warn"|"error"'
MESSAGE_REASON = "message: Invalid input: expected string, received undefined"

ENTRIES = f"""
entries AS (
  SELECT 'req-' || CAST(event_id // 100 AS VARCHAR) AS request_id,
         CAST(event_id % 100 AS INTEGER) AS index,
         second(ts) AS s, *,
         CASE second(ts)
           WHEN 3 THEN '{LEVEL_REASON}'
           WHEN 7 THEN '{MESSAGE_REASON}'
           WHEN 11 THEN 'service: must not be empty'
           WHEN 17 THEN 'timestamp: Invalid ISO datetime'
           WHEN 19 THEN 'timestamp: timestamp cannot be more than 5 minutes in the future'
           WHEN 23 THEN 'attributes: Invalid input'
           WHEN 29 THEN 'attributes: Invalid input: expected record, received null'
           WHEN 31 THEN '{LEVEL_REASON}, {MESSAGE_REASON}'
           WHEN 37 THEN 'entry: Invalid input: expected object'
         END AS reason
  FROM events)
"""

HASH = "sha256(request_id || ':' || CAST(index AS VARCHAR))"


def _uuid(hash_: str) -> str:
    spans = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return " || '-' || ".join(f"substr({hash_}, {start}, {length})" for start, length in spans)


ACCEPTED = f"""
accepted AS (
  SELECT request_id, {_uuid(HASH)} AS id,
         CASE WHEN s = 43 THEN date_trunc('minute', ts)
              ELSE date_trunc('millisecond', ts) END AS timestamp,
         CASE WHEN value >= 60 THEN 'error' WHEN value >= 30 THEN 'warn'
              WHEN value >= 5 THEN 'info' ELSE 'debug' END AS level,
         event_type AS service,
         event_type || ' user ' || CAST(user_id AS VARCHAR) || ' value '
           || CAST(value AS VARCHAR) AS message,
         CASE WHEN s <> 41 THEN CAST(user_id AS VARCHAR) END AS attr_user_id,
         CASE WHEN s <> 41 THEN regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') END AS attr_value,
         CASE WHEN s <> 41 THEN event_type END AS attr_type,
         CASE WHEN s <> 41 THEN CASE WHEN value >= 60 THEN 'true' ELSE 'false' END END AS attr_big
  FROM entries WHERE reason IS NULL)
"""

ACCEPTED_ROWS = _ctes(ENTRIES, ACCEPTED) + (
    "SELECT id, timestamp, level, service, message, attr_user_id, attr_value, attr_type, attr_big "
    "FROM accepted"
)
REJECTED_ROWS = _ctes(ENTRIES) + (
    "SELECT request_id, index, reason FROM entries WHERE reason IS NOT NULL"
)
RECEIPTS = (
    _ctes(ENTRIES)
    + """
SELECT request_id,
       CASE WHEN count(*) = count(reason) THEN 'no_valid_entries' ELSE 'ok' END AS status,
       CAST(CASE WHEN count(*) = count(reason) THEN 400 ELSE 200 END AS INTEGER) AS http_status,
       CAST(count(*) - count(reason) AS INTEGER) AS accepted,
       CAST(count(reason) AS INTEGER) AS rejected,
       coalesce(string_agg(CAST(index AS VARCHAR) || '=' || reason, '; ' ORDER BY index)
                FILTER (reason IS NOT NULL), '') AS reasons
FROM entries GROUP BY request_id
"""
)
ORDER_STATUS = f"""
WITH shaped AS (
  SELECT o_orderkey, o_orderstatus,
         CASE WHEN o_orderpriority LIKE '1%' THEN 'malformed_json'
              WHEN o_orderpriority LIKE '2%' THEN 'no_valid_entries'
              WHEN o_orderpriority LIKE '3%' THEN 'logs_not_a_list'
              WHEN o_orderstatus = 'O' THEN 'malformed_json'
              WHEN o_orderpriority LIKE '4%' THEN 'missing_logs'
              WHEN o_orderstatus = 'P' THEN 'no_valid_entries'
              ELSE 'ok' END AS status,
         o_orderpriority NOT LIKE '2%' AS has_entry
  FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS request_id, status,
       CAST(CASE status WHEN 'ok' THEN 200 ELSE 400 END AS INTEGER) AS http_status,
       CAST(CASE status WHEN 'ok' THEN 1 ELSE 0 END AS INTEGER) AS accepted,
       CAST(CASE WHEN status = 'no_valid_entries' AND has_entry THEN 1 ELSE 0 END AS INTEGER)
         AS rejected,
       CASE WHEN status = 'no_valid_entries' AND has_entry THEN '0={LEVEL_REASON}' ELSE '' END
         AS reasons
FROM shaped
"""

# --- reconciliation ------------------------------------------------------------------------------

VISIBLE = """
copies AS (
  SELECT *, CASE WHEN hour(timestamp) = 3 AND minute(timestamp) < 10 THEN 0
                 WHEN hour(timestamp) = 17 AND minute(timestamp) BETWEEN 30 AND 34 THEN 2
                 ELSE 1 END AS visible
  FROM event_logs)
"""

# --- load tests ----------------------------------------------------------------------------------

REQUESTS = """
requests AS (
  SELECT *, CASE WHEN day(ts) <= 7 THEN 'load' WHEN day(ts) <= 14 THEN 'stress'
                 WHEN day(ts) <= 21 THEN 'spike' ELSE 'breakpoint' END AS scenario,
         CASE WHEN day(ts) <= 7 THEN 'load'
              WHEN day(ts) <= 14 THEN ['15k', '22.5k', '30k'][hour(ts) // 8 + 1]
              WHEN day(ts) <= 21 THEN ['normal', 'spike', 'recovery'][hour(ts) // 8 + 1]
              ELSE ['15k', '22.5k', '30k', '45k'][hour(ts) // 6 + 1] END AS phase,
         CASE event_type WHEN 'view' THEN 'query' WHEN 'error' THEN 'aggregate'
              ELSE 'ingest' END AS type
  FROM events)
"""

SAMPLES = REQUESTS.rstrip() + """,
samples AS (
  SELECT 'run-1' AS run_id, scenario, phase, type, status, duration_ms, dropped,
         CASE WHEN type <> 'ingest' THEN 0 WHEN status <> 200 THEN 100 ELSE refused END AS rejected,
         CASE WHEN type <> 'ingest' THEN 0 WHEN status <> 200 THEN 0 ELSE 100 - refused END
           AS accepted
  FROM (
    SELECT scenario, phase, type,
           CASE WHEN value >= 100 THEN 503 WHEN value >= 90 THEN 422 ELSE 200 END AS status,
           value * 10 AS duration_ms,
           CASE WHEN value >= 140 THEN 1 ELSE 0 END AS dropped,
           CASE WHEN second(ts) < 2 THEN 5 ELSE 0 END AS refused
    FROM requests))
"""

RUN_SAMPLES = REQUESTS.rstrip() + """,
samples AS (
  SELECT run_id, scenario, phase, type, CASE WHEN lost THEN 503 ELSE 200 END AS status,
         CASE WHEN run_id IN ('slow', 'fading') THEN value * 1000 ELSE value END AS duration_ms,
         CASE WHEN type <> 'ingest' OR lost THEN 0
              WHEN run_id IN ('starved', 'slow', 'erring', 'failing') THEN 1
              WHEN run_id = 'fading' AND phase IN ('30k', '45k', 'spike', 'recovery') THEN 1
              ELSE 10000000 END AS accepted,
         0 AS rejected, CASE WHEN run_id = 'starved' THEN 1 ELSE 0 END AS dropped
  FROM (SELECT *, (run_id = 'erring' AND event_id % 14 = 0) OR (run_id = 'failing' AND event_id % 4 = 0) AS lost
        FROM (SELECT *, ['held', 'starved', 'slow', 'stuck', 'crashed', 'fading', 'erring', 'failing']
                [user_id % 8 + 1] AS run_id FROM requests)))
"""

PLAN = (
    "plan AS (SELECT * FROM (VALUES "
    + ", ".join(
        f"('{scenario}', {number}, '{phase}', {target}, {seconds}, {LATENCY_MS[scenario]})"
        for scenario, phases in PHASES.items()
        for number, (phase, target, seconds) in enumerate(phases)
    )
    + ") AS p(scenario, phase_number, phase, target, seconds, latency_limit))"
)

HTTP_ERROR = "(status = 0 OR status >= 500)"
APPLICATION_ERROR = (
    "((status <> 200 AND NOT (status = 0 OR status >= 500)) "
    "OR (type = 'ingest' AND status = 200 AND rejected > 0))"
)


def _rollup(keys: str) -> str:
    return f"""
SELECT {keys}, count(*) AS requests,
       CAST(sum(accepted) AS BIGINT) AS accepted_records,
       CAST(sum(rejected) AS BIGINT) AS rejected_records,
       count(*) FILTER ({HTTP_ERROR}) AS http_errors,
       count(*) FILTER ({APPLICATION_ERROR}) AS application_errors,
       count(*) FILTER (NOT status BETWEEN 200 AND 399) AS failed_requests,
       CAST(sum(dropped) AS BIGINT) AS dropped_iterations
FROM samples GROUP BY {keys}
"""


def _p95(keys: str) -> str:
    columns = [
        f"coalesce(round(quantile_cont(duration_ms, 0.95) FILTER (type = '{type_}'), 4), 0.0) AS {name}"
        for type_, name in (
            ("ingest", "latency_p95_ms"),
            ("query", "query_p95_ms"),
            ("aggregate", "aggregate_p95_ms"),
        )
    ]
    return f"SELECT {keys}, {', '.join(columns)} FROM samples GROUP BY {keys}"


def _scenario(samples: str) -> str:
    return _ctes(
        samples,
        PLAN,
        f"totals AS ({_rollup('run_id, scenario')})",
        f"latency AS ({_p95('run_id, scenario')})",
        """
scenarios AS (
  SELECT t.*, l.latency_p95_ms, p.offered, p.seconds, p.latency_limit,
         round(t.accepted_records / greatest(1, p.seconds), 4) AS logs_per_second,
         t.failed_requests / t.requests AS error_rate
  FROM totals t JOIN latency l USING (run_id, scenario)
  JOIN (SELECT scenario, sum(seconds) AS seconds, max(latency_limit) AS latency_limit,
               CAST(round(sum(target * seconds) / sum(seconds)) AS BIGINT) AS offered
        FROM plan GROUP BY scenario) p USING (scenario))
""",
    )


SCENARIO, RUN_SCENARIO = _scenario(SAMPLES), _scenario(RUN_SAMPLES)


def _limited(target: str, achieved: str) -> str:
    slow = f"({achieved} / {target} < 0.95)"
    return (
        f"CASE WHEN error_rate > 0.01 OR ({slow} AND latency_p95_ms > latency_limit * 1.5 "
        "AND dropped_iterations <= 10) THEN 'service' "
        f"WHEN dropped_iterations > 10 OR {slow} THEN 'generator' ELSE 'none' END"
    )


PHASE_ROWS = f"""
phase_rows AS (
  SELECT s.run_id, p.scenario, p.phase, p.phase_number, p.target, p.seconds, s.latency_p95_ms,
         s.error_rate, s.dropped_iterations, p.latency_limit,
         coalesce(a.accepted, 0) AS accepted_records,
         coalesce(a.accepted, 0) / greatest(1, p.seconds) AS achieved
  FROM scenarios s JOIN plan p USING (scenario)
  LEFT JOIN (SELECT run_id, scenario, phase, sum(accepted) AS accepted
             FROM samples GROUP BY ALL) a
    ON a.run_id = s.run_id AND a.scenario = p.scenario AND a.phase = p.phase),
phases AS (
  SELECT run_id, scenario, phase, CAST(phase_number AS INTEGER) AS phase_number,
         CAST(target AS INTEGER) AS target_logs_per_second, CAST(seconds AS INTEGER) AS seconds,
         CAST(accepted_records AS BIGINT) AS accepted_records,
         round(achieved, 4) AS achieved_logs_per_second,
         {_limited('target', 'achieved')} AS limited_by,
         achieved >= target * 0.95 OR {_limited('target', 'achieved')} = 'generator'
           AS threshold_passed
  FROM phase_rows)
"""
PHASES_SQL, RUN_PHASES_SQL = (sql.rstrip() + ",\n" + PHASE_ROWS.strip() + "\n" for sql in (SCENARIO, RUN_SCENARIO))

BREAKPOINTS = """
SELECT run_id, scenario,
       arg_max(target_logs_per_second, phase_number)
         FILTER (threshold_passed AND limited_by <> 'service') AS sustainable_logs_per_second,
       arg_min(target_logs_per_second, phase_number)
         FILTER (NOT (threshold_passed AND limited_by <> 'service')) AS breaking_logs_per_second
FROM phases GROUP BY 1, 2
"""

# --- generators ----------------------------------------------------------------------------------


def _draws(names: tuple[str, ...], seed: int = 1337) -> str:
    """CTEs that give one uniform column per name, in 128-bit arithmetic."""
    n, word = len(names), 4294967296

    def columns(f) -> str:
        return ", ".join(f"{f(i, name)} AS {name}" for i, name in enumerate(names))

    def times(a: str, b: str) -> str:
        return f"CAST((CAST({a} AS HUGEINT) * ({b})) % {word} AS BIGINT)"

    def state(i, _):
        return f"CAST(({seed} + CAST({n} * event_id + {i + 1} AS HUGEINT) * 1831565813) % {word} AS BIGINT)"

    def first(_, t):
        return times(f"xor({t}, {t} >> 15)", f"{t} | 1")

    def second(_, t):
        return f"xor({t}, ({t} + {times(f'xor({t}, {t} >> 7)', f'{t} | 61')}) % {word})"

    def last(_, t):
        return f"xor({t}, {t} >> 14) / {word}.0::DOUBLE"

    return f"""
d0 AS (SELECT event_id AS n, {columns(state)} FROM events),
d1 AS (SELECT n, {columns(first)} FROM d0),
d2 AS (SELECT n, {columns(second)} FROM d1),
draws AS (SELECT n, {columns(last)} FROM d2)
"""


def _pick(choices: tuple[str, ...], uniform: str) -> str:
    words = ", ".join(f"'{choice}'" for choice in choices)
    return f"[{words}][CAST(floor({uniform} * {len(choices)}) AS INTEGER) + 1]"


def _cycle(choices: tuple[str, ...], shift: str = "0") -> str:
    words = ", ".join(f"'{choice}'" for choice in choices)
    return f"[{words}][(i + CAST(floor({shift} * {len(choices)}) AS INTEGER)) % {len(choices)} + 1]"


SEED_NOW_MS = 1706745600000
SEEDED_ROWS = f"""
seeded AS (
  SELECT n, {_uuid("sha256('seeded:1337:' || CAST(n AS VARCHAR))")} AS id,
         make_timestamp_ms(CAST(floor({SEED_NOW_MS}.0::DOUBLE - "offset" * 2592000000.0::DOUBLE) AS BIGINT))
           AS timestamp,
         {_pick(SEEDED.levels, 'level')} AS level,
         {_pick(SEEDED.services, 'service')} AS service,
         {_pick(SEEDED.messages, 'message')} || ' [b' || CAST(n // 500 AS VARCHAR) || '-i'
           || CAST(n % 500 AS VARCHAR) || ']' AS message,
         CAST(CAST(floor("user" * 100000) AS BIGINT) AS VARCHAR) AS attr_user_id,
         {_pick(SEEDED.regions, 'region')} AS attr_region,
         CAST(CAST(floor(duration * 500) AS BIGINT) AS VARCHAR) AS attr_duration_ms,
         CASE WHEN cached > 0.5 THEN 'true' ELSE 'false' END AS attr_cached,
         '1.0' AS attr_version
  FROM draws)
"""
SEEDED_CTES = _ctes(
    _draws(('"offset"', "service", "level", "message", "region", '"user"', "duration", "cached")),
    SEEDED_ROWS,
)
UNIFORM_SQL = _ctes(
    _draws(("service", "level", '"offset"', "message", '"user"', "region", "retries"))
) + f"""
SELECT {_uuid("sha256('uniform:1337:' || CAST(n AS VARCHAR))")} AS id,
       make_timestamp_ms(CAST(floor(1782864000000.0::DOUBLE + "offset" * 2592000000.0::DOUBLE) AS BIGINT))
         AS timestamp,
       {_pick(UNIFORM.levels, 'level')} AS level, {_pick(UNIFORM.services, 'service')} AS service,
       {_pick(UNIFORM.messages, 'message')} AS message,
       CAST(CAST(floor("user" * 100000) AS BIGINT) AS VARCHAR) AS attr_user_id,
       {_pick(UNIFORM.regions, 'region')} AS attr_region,
       CAST(CAST(floor(retries * 4) AS BIGINT) AS VARCHAR) AS attr_retries
FROM draws
"""
LOAD_SQL = _ctes(_draws(("level", "service"))) + f"""
SELECT {_uuid("sha256('run-1:1337:' || CAST(n AS VARCHAR))")} AS id,
       make_timestamp_ms({SEED_NOW_MS} - i * 10) AS timestamp,
       {_cycle(LOAD.levels, 'level')} AS level, {_cycle(LOAD.services, 'service')} AS service,
       {_cycle(LOAD.messages)} || ' [vu=' || CAST(batch % 20 + 1 AS VARCHAR) || ' iter='
         || CAST(batch // 20 AS VARCHAR) || ' i=' || CAST(i AS VARCHAR) || ']' AS message,
       CAST(((batch % 20 + 1) * 10000 + i) % 100000 AS VARCHAR) AS attr_user_id,
       {_cycle(LOAD.regions)} AS attr_region, CAST(i % 4 AS VARCHAR) AS attr_retries,
       'run-1' AS attr_run_id
FROM (SELECT *, n % 100 AS i, n // 100 AS batch FROM draws)
"""

EVENT_ROWS = (
    _ctes(EVENT_LOGS)
    + "SELECT id, timestamp, level, service, message, attr_k, attr_user_id FROM event_logs"
)
ROLLUP_WHERE = (
    "timestamp > TIMESTAMP '2024-01-02 03:04:05.678' "
    "AND timestamp < TIMESTAMP '2024-01-27 08:09:10.111' AND service = 'view'"
)

ORACLE_SQL: dict[str, str] = {
    "list_all_default": _list_events(),
    "list_limit": _list_events(limit=1000),
    "list_since_until": _list_events(
        "timestamp >= TIMESTAMP '2024-01-10 06:00:00' "
        "AND timestamp < TIMESTAMP '2024-01-11 18:30:00.5'"
    ),
    "list_since_edge": _list(
        "order_logs",
        "attr_customer",
        "timestamp >= TIMESTAMP '1997-08-23' AND timestamp < TIMESTAMP '1997-08-25'",
        1000,
    ),
    "list_since_equals_until": _list("order_logs", "attr_customer", "false"),
    "list_service": _list_events("service = 'purchase'"),
    "list_level": _list_events("level = 'error'"),
    "list_empty_filters": _list_events(limit=50),
    "list_q": _list_events("message ILIKE '%USER 1%'"),
    "list_q_wildcard": _list_events("message ILIKE '%u_er 1%value 2_.5%'"),
    "list_q_literal": _list("document_logs", "attr_lang", "contains(message, '%')", 1000),
    "list_q_trigrams": _list("document_logs", "attr_lang", "message ILIKE '%the%of and%'", 1000),
    "list_q_documents": _list("document_logs", "attr_lang", "message ILIKE '%THE OF%'", 1000),
    "list_attr": _list_events("attr_k = '69'"),
    "list_attr_shredded": _list_events("attr_k = '69'"),
    "list_attr_two": _list_events("attr_k = '69' AND attr_user_id = '8'"),
    "list_attr_missing_empty": _list_events(),
    "list_combined": _list_events(
        "service = 'click' AND level = 'warn' AND timestamp >= TIMESTAMP '2024-01-05' "
        "AND timestamp < TIMESTAMP '2024-01-25' AND message ILIKE '%value 4%'",
        200,
    ),
    "list_page2_cursor": _list("order_logs", "attr_customer", limit=250, skip=250),
    "list_next_cursor": _ctes(
        ORDER_LOGS,
        f"""
placed AS (
  SELECT id, {ISO} AS iso, row_number() OVER (ORDER BY timestamp DESC, id DESC) AS place
  FROM order_logs)
""",
    )
    + """
SELECT CAST(least(count(*), 250) AS INTEGER) AS rows, count(*) > 250 AS has_next,
       CASE WHEN count(*) > 250 THEN
         rtrim(translate(to_base64(encode('{"timestamp":"' || max(iso) FILTER (place = 250)
           || '","id":"' || max(id) FILTER (place = 250) || '"}')), '+/', '-_'), '=')
       END AS next_cursor
FROM placed
""",
    "page_walk": _pages("event_logs", 100),
    "page_walk_ties": _pages("order_logs", 250),
    "agg_1m": _count("1m"),
    "agg_5m_service": _count("5m", "service"),
    "agg_1h_service": _count("1h", "service"),
    "agg_1h_level": _count("1h", "level"),
    "agg_1d": _count("1d"),
    "agg_since_edge": _count(
        "1d",
        where="timestamp > TIMESTAMP '1997-08-23' AND timestamp < TIMESTAMP '1997-08-30'",
        source="order_logs",
    ),
    "agg_filtered": _count(
        "5m",
        "service",
        "timestamp > TIMESTAMP '2024-01-03' AND timestamp < TIMESTAMP '2024-01-28 12:34:56.789' "
        "AND level = 'error' AND message ILIKE '%user 1%'",
    ),
    "agg_attr": _count("1d", "level", "attr_k = '69'"),
    "agg_lines_1d_level": _count("1d", "level", source="line_logs"),
    "agg_total": "SELECT count(*) AS total FROM events",
    "agg_group_totals": 'SELECT event_type AS "group", count(*) AS total FROM events GROUP BY 1',
    "agg_from_rollup": _count("5m", "level", ROLLUP_WHERE),
    "ingest_accepted": ACCEPTED_ROWS,
    "ingest_rejected": REJECTED_ROWS,
    "ingest_receipts": RECEIPTS,
    "ingest_status": ORDER_STATUS,
    "ingest_lenient": REJECTED_ROWS + " AND s <> 11",
    "ingest_normalised": _ctes(ENTRIES, ACCEPTED)
    + """
SELECT key, value, count(*) AS rows FROM (
  SELECT unnest(['user_id', 'value', 'type', 'big']) AS key,
         unnest([attr_user_id, attr_value, attr_type, attr_big]) AS value
  FROM accepted WHERE attr_type IS NOT NULL)
GROUP BY ALL
""",
    "ingest_totals": _ctes(ENTRIES)
    + """
SELECT count(DISTINCT request_id) AS requests, count(*) AS attempted,
       count(*) - count(reason) AS accepted, count(reason) AS rejected
FROM entries
""",
    "id_assignment": _ctes(ENTRIES, ACCEPTED) + "SELECT request_id, id, timestamp FROM accepted",
    "dedup_by_id": _ctes(EVENT_LOGS, VISIBLE)
    + "SELECT id, timestamp, level, service, message, attr_k, attr_user_id "
    "FROM copies WHERE visible > 0",
    "bulk_load_json": EVENT_ROWS,
    "bulk_load_default_id": "SELECT count(*) AS rows, count(*) AS distinct_ids, "
    "true AS all_distinct FROM events",
    "table_listing": _list_events(
        "timestamp >= TIMESTAMP '2024-01-12' AND timestamp < TIMESTAMP '2024-01-14 12:00:00' "
        "AND level = 'error'"
    ),
    "table_buckets": _count(
        "1h",
        "service",
        "timestamp > TIMESTAMP '2024-01-12' AND timestamp < TIMESTAMP '2024-01-14 12:00:00'",
    ),
    "retention_30d": EVENT_ROWS + " WHERE timestamp >= TIMESTAMP '2024-01-11 12:00:00'",
    "retention_days_dropped": "SELECT CAST(ts AS DATE) AS dt, count(*) AS rows FROM events "
    "WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY 1",
    "reconcile_counts": _ctes(EVENT_LOGS, VISIBLE)
    + """
SELECT run_id, a AS accepted_records, v AS visible_records,
       greatest(0, a - v) AS missing_records, greatest(0, v - a) AS duplicate_records,
       least(1.0::DOUBLE, round(v / a, 4)) AS visibility_rate, a <= v AS consistency_passed
FROM (SELECT strftime(timestamp, 'run-%Y%m%d') AS run_id, count(*) AS a,
             CAST(sum(visible) AS BIGINT) AS v
      FROM copies GROUP BY 1)
""",
    "reconcile_missing": _ctes(EVENT_LOGS, VISIBLE)
    + "SELECT id, message, CAST(1 AS BIGINT) AS missing FROM copies WHERE visible = 0",
    "reconcile_duplicates": _ctes(EVENT_LOGS, VISIBLE)
    + "SELECT id, message, CAST(1 AS BIGINT) AS surplus FROM copies WHERE visible = 2",
    "reconcile_set": _ctes(EVENT_LOGS, VISIBLE)
    + "SELECT count(*) FILTER (visible = 0) AS missing, count(*) FILTER (visible = 2) AS surplus, "
    "count(*) FILTER (visible <> 1) = 0 AS passed FROM copies",
    "distinct_ids": _ctes(EVENT_LOGS, VISIBLE)
    + "SELECT CAST(sum(visible) AS BIGINT) AS rows, count(*) FILTER (visible > 0) AS distinct_ids, "
    "sum(visible) = count(*) FILTER (visible > 0) AS all_distinct FROM copies",
    "read_after_write": _ctes(EVENT_LOGS, VISIBLE)
    + """
SELECT run_id, count(*) AS probes_total, count(*) FILTER (found) AS probes_passed,
       round(count(*) FILTER (found) / greatest(1, count(*)), 4) AS read_after_write_rate
FROM (SELECT strftime(timestamp, 'run-%Y%m%d') AS run_id,
             message IN (SELECT message FROM copies WHERE visible > 0 AND service = 'signup')
               AS found
      FROM copies WHERE service = 'signup')
GROUP BY 1
""",
    "loadtest_rollup": _ctes(SAMPLES) + _rollup("run_id, scenario, phase"),
    "loadtest_p95": _ctes(SAMPLES) + _p95("run_id, scenario"),
    "loadtest_p95_phases": _ctes(SAMPLES) + _p95("run_id, scenario, phase"),
    "loadtest_throughput": SCENARIO
    + """
SELECT run_id, scenario, offered AS offered_logs_per_second, logs_per_second,
       accepted_records, rejected_records, dropped_iterations, error_rate,
       http_errors / requests AS http_error_rate,
       application_errors / requests AS application_error_rate,
       rejected_records + dropped_iterations * 100 AS requests_lost
FROM scenarios
""",
    "loadtest_limitation": PHASES_SQL + "SELECT * FROM phases",
    "loadtest_status": SCENARIO
    + f"""
SELECT run_id, scenario, limited_by, threshold_passed,
       CASE WHEN threshold_passed OR limited_by = 'generator' THEN 'completed'
            WHEN error_rate > 0.1 THEN 'failed' ELSE 'degraded' END AS status
FROM (SELECT *, (logs_per_second >= offered * 0.95 OR limited_by = 'generator')
                AND error_rate <= 0.05 AS threshold_passed
      FROM (SELECT *, {_limited('offered', 'logs_per_second')} AS limited_by FROM scenarios))
""",
    "loadtest_breakpoint": PHASES_SQL + BREAKPOINTS,
    "loadtest_outcomes": RUN_SCENARIO
    + f"""
SELECT run_id, scenario, error_rate, limited_by, threshold_passed,
       CASE WHEN run_id = 'stuck' AND scenario IN ('spike', 'breakpoint') THEN 'failed'
            WHEN run_id = 'crashed' THEN 'failed'
            WHEN threshold_passed OR limited_by = 'generator' THEN 'completed'
            WHEN error_rate > 0.1 THEN 'failed' ELSE 'degraded' END AS status
FROM (SELECT *, (logs_per_second >= offered * 0.95 OR limited_by = 'generator')
                AND error_rate <= 0.05 AS threshold_passed
      FROM (SELECT *, {_limited('offered', 'logs_per_second')} AS limited_by FROM scenarios))
""",
    "loadtest_outcome_phases": RUN_PHASES_SQL + "SELECT * FROM phases",
    "loadtest_outcome_breakpoints": RUN_PHASES_SQL + BREAKPOINTS,
    "loadtest_visible_consistency": _ctes(EVENT_LOGS, VISIBLE)
    + """
SELECT run_id, scenario, accepted_records, visible_records, read_after_write_rate,
       visible_records >= accepted_records * 0.95 OR read_after_write_rate >= 0.8 AS consistency_passed
FROM (SELECT run_id, scenario, count(*) AS accepted_records,
             CASE WHEN sum(visible) = 0 THEN count(*) ELSE CAST(sum(visible) AS BIGINT) END AS visible_records,
             coalesce(round(count(*) FILTER (probe AND readable) / nullif(count(*) FILTER (probe), 0), 4), 0.0)
               AS read_after_write_rate
      FROM (SELECT *, service = 'signup' AS probe,
                   message IN (SELECT message FROM copies WHERE visible > 0 AND service = 'signup') AS readable,
                   strftime(timestamp, 'slot-%H') || CAST(minute(timestamp) // 15 AS VARCHAR) AS run_id,
                   CASE WHEN day(timestamp) <= 7 THEN 'load' WHEN day(timestamp) <= 14 THEN 'stress'
                        WHEN day(timestamp) <= 21 THEN 'spike' ELSE 'breakpoint' END AS scenario
            FROM copies)
      GROUP BY 1, 2)
""",
    "weighted_rate": PHASES_SQL
    + """
SELECT run_id, scenario,
       CAST(round(sum(achieved_logs_per_second * seconds) / sum(seconds)) AS BIGINT) AS mean_rate
FROM phases GROUP BY 1, 2
""",
    "loadtest_consistency": _ctes(SAMPLES)
    + """
SELECT run_id, scenario, accepted_records, visible_records, read_after_write_rate,
       visible_records >= accepted_records * 0.95 OR read_after_write_rate >= 0.8
         AS consistency_passed
FROM (SELECT run_id, scenario, CAST(sum(accepted) AS BIGINT) AS accepted_records,
             CAST(sum(CASE WHEN duration_ms > 400 THEN 60 ELSE accepted END)
                    FILTER (type = 'ingest' AND status = 200) AS BIGINT) AS visible_records,
             round(count(*) FILTER (duration_ms <= 300) / count(*), 4) AS read_after_write_rate
      FROM samples GROUP BY 1, 2)
""",
    "seed_generate": SEEDED_CTES
    + "SELECT id, timestamp, level, service, message, attr_user_id, attr_region, "
    "attr_duration_ms, attr_cached, attr_version FROM seeded",
    "seed_level_mix": SEEDED_CTES
    + "SELECT service, level, count(*) AS rows FROM seeded GROUP BY 1, 2",
    "seed_ingest": SEEDED_CTES
    + "SELECT date_trunc('day', timestamp)::TIMESTAMP AS start, count(*) AS count "
    "FROM seeded GROUP BY 1",
    "seed_uniform": UNIFORM_SQL,
    "seed_load_shape": LOAD_SQL,
    "stream_ingest": ACCEPTED_ROWS,
    "stream_ingest_rejects": REJECTED_ROWS,
    "stream_ingest_receipts": RECEIPTS,
    "stream_rollup": _ctes(ENTRIES, ACCEPTED)
    + f'SELECT {FLOORS["5m"]} AS start, level AS "group", count(*) AS count '
    f"FROM accepted WHERE {ROLLUP_WHERE} GROUP BY 1, 2",
    "stream_bucket_counts": _count("1h", "service"),
    "reload_replaces_batch": f"SELECT * FROM ({EVENT_ROWS}) "
    "WHERE timestamp >= TIMESTAMP '2024-01-15 00:00:00'",
    "stream_slices_ingest": ACCEPTED_ROWS,
    "quantile_range": """
SELECT event_type AS service, round(quantile_cont(value, 0.95), 6) AS p95 FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1
""",
    "reconcile_digests": _ctes(EVENT_LOGS, VISIBLE)
    + "SELECT id, 1::BIGINT AS expected, visible::BIGINT AS found FROM copies WHERE visible <> 1",
    "probe_stream": _ctes(EVENT_LOGS, VISIBLE)
    + """
SELECT run_id, count(*) AS probes_total, count(*) FILTER (answered) AS probes_passed,
       round(count(*) FILTER (answered) / count(*), 4) AS read_after_write_rate
FROM (SELECT strftime(p.timestamp, 'run-%Y%m%d') AS run_id,
             EXISTS (SELECT 1 FROM copies l
                     WHERE l.service = 'signup' AND l.visible > 0 AND l.message = p.message
                       AND l.timestamp + to_seconds(CAST(l.attr_user_id AS BIGINT) % 45)
                           BETWEEN p.timestamp AND p.timestamp + INTERVAL 30 SECOND) AS answered
      FROM copies p WHERE p.service = 'signup')
GROUP BY 1
""",
    "distinct_ranges": """
SELECT service, count(*) FILTER (a) AS in_first, count(*) FILTER (b) AS in_second, count(*) AS in_either,
       count(*) FILTER (a AND b) AS in_both, count(*) FILTER (a AND NOT b) AS only_first, true AS within_bound
FROM (SELECT event_type AS service, user_id,
             bool_or(ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-14') AS a,
             bool_or(ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-25') AS b
      FROM events GROUP BY 1, 2)
WHERE a OR b GROUP BY 1
""",
    "merge_days": EVENT_ROWS,
    "merge_rollup": _count("5m", "level", ROLLUP_WHERE),
    "stream_dedup": _ctes(EVENT_LOGS, VISIBLE)
    + "SELECT id, timestamp, level, service, message, attr_k, attr_user_id "
    "FROM copies WHERE visible > 0",
}
