"""Event ingest queries (E1-E10) with oracles.

The oracle SQL states the rules again, for DuckDB's own JSON and regex functions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import events
from keelson.plans.registry import query
from keelson.session import cut_lineage

C = F.col
NOW = "2024-02-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _jf(name):
    return f"json_extract_string(body, '$.{name}')"


_TYPE = "regexp_replace(raw_type, '^EventType\\.', '')"


# The rules written out again by hand, so that a wrong constant in the code shows.
_VALIDATE = f"""CASE
  WHEN NOT coalesce(json_valid(body) AND json_type(body) = 'OBJECT', false) THEN 'body must be a JSON object.'
  WHEN {_TYPE} = 'telemetry' AND coalesce({_jf('metric')}, '') = '' THEN 'telemetry: metric is required.'
  WHEN {_TYPE} = 'alert' AND coalesce({_jf('severity')}, '') = '' THEN 'alert: severity is required.'
  WHEN {_TYPE} = 'alert' AND coalesce({_jf('message')}, '') = '' THEN 'alert: message is required.'
  WHEN {_TYPE} = 'diagnostic' AND coalesce({_jf('diagnostic_type')}, '') = '' THEN 'diagnostic: diagnostic_type is required.'
  WHEN {_TYPE} = 'log' AND coalesce({_jf('level')}, '') = '' THEN 'log: level is required.'
  WHEN {_TYPE} = 'log' AND coalesce({_jf('message')}, '') = '' THEN 'log: message is required.'
  WHEN {_TYPE} = 'ai_interaction' AND coalesce({_jf('role')}, '') = '' THEN 'ai_interaction: role is required.'
  WHEN {_TYPE} = 'ai_interaction' AND coalesce({_jf('content')}, '') = '' THEN 'ai_interaction: content is required.'
  WHEN {_TYPE} = 'telemetry' AND json_type(body, '$.value') IS NULL THEN 'telemetry: value is required.'
  WHEN json_type(body, '$.tags') <> 'OBJECT' THEN 'tags must be an object.'
  WHEN {_TYPE} = 'diagnostic' AND json_type(body, '$.payload') <> 'OBJECT' THEN 'payload must be an object.'
  WHEN {_TYPE} = 'snapshot' AND json_type(body, '$.state') <> 'OBJECT' THEN 'state must be an object.'
  WHEN {_TYPE} = 'ai_interaction' AND json_type(body, '$.context') <> 'OBJECT' THEN 'context must be an object.'
END"""


VALIDATE_SQL = f"SELECT source_event_id, {_TYPE} AS event_type, {_VALIDATE} AS reject_reason FROM ingest_events"


@query("validate_events", VALIDATE_SQL)
def q_validate_events(r):
    """E1 JSON object bodies with the fields their type requires."""
    return events.validate_events(r.ingest_events).select("source_event_id", "event_type", "reject_reason")


def _ident(expr):
    return f"CASE WHEN length(trim({expr})) > 0 THEN trim({expr}) END"


def _ok(c):
    return f"({c} IS NULL OR (length({c}) <= 200 AND regexp_matches({c}, '^[A-Za-z0-9_.:-]+$')))"


def _resolve_sql(strict: bool) -> str:
    pick = lambda f: ("CASE " + " ".join(f"WHEN r{i}.ri IS NOT NULL THEN r{i}.{f}" for i in range(1, 5))
                      + " END")
    found = "(r1.ri IS NOT NULL OR r2.ri IS NOT NULL OR r3.ri IS NOT NULL OR r4.ri IS NOT NULL)"
    reason = (f"CASE WHEN NOT ({_ok('ev.k')} AND {_ok('ev.i')}) THEN 'Invalid system identifier.' "
              f"WHEN ev.k IS NULL AND ev.i IS NULL THEN 'system_key or system_id is required.' "
              + (f"WHEN NOT {found} THEN 'System is not registered.' " if strict else "") + "END")
    return f"""
WITH ev AS (SELECT source_event_id, {_ident('COALESCE(system_key, batch_system_key)')} AS k,
                   {_ident('COALESCE(system_id, batch_system_id)')} AS i FROM ingest_events),
reg AS (SELECT CAST(system_key AS VARCHAR) AS rk, CAST(system_id AS VARCHAR) AS ri, system_name AS rn FROM systems)
SELECT ev.source_event_id,
       CASE WHEN {found} THEN {pick('ri')} ELSE ev.i END AS system_id,
       CASE WHEN {found} THEN {pick('rk')} ELSE COALESCE(ev.k, ev.i) END AS system_key,
       CASE WHEN {found} THEN {pick('rn')} ELSE COALESCE(ev.k, ev.i) END AS system_name,
       {found} AS registry_validated,
       {reason} AS reject_reason
FROM ev
LEFT JOIN reg r1 ON r1.rk = ev.k LEFT JOIN reg r2 ON r2.ri = ev.k
LEFT JOIN reg r3 ON r3.ri = ev.i LEFT JOIN reg r4 ON r4.rk = ev.i
"""


_RES_COLS = ["source_event_id", "system_id", "system_key", "system_name", "registry_validated", "reject_reason"]


@query("resolve_system_strict", _resolve_sql(True), bench=True)
def q_resolve_strict(r):
    """E2 registry resolution, unknown systems rejected."""
    return events.resolve_system(r.ingest_events, r.systems, strict=True).select(*_RES_COLS)


@query("resolve_system_lenient", _resolve_sql(False))
def q_resolve_lenient(r):
    """E2 registry resolution, unknown systems passed with registry_validated = false."""
    return events.resolve_system(r.ingest_events, r.systems, strict=False).select(*_RES_COLS)


TS_SQL = f"""
SELECT source_event_id,
       CASE WHEN timestamp_text IS NULL THEN TIMESTAMP '{NOW}'
            ELSE TRY_CAST(regexp_replace(trim(timestamp_text), 'Z$', '') AS TIMESTAMP) END AS timestamp,
       CASE WHEN timestamp_text IS NOT NULL AND TRY_CAST(regexp_replace(trim(timestamp_text), 'Z$', '') AS TIMESTAMP) IS NULL
            THEN 'timestamp must be a valid ISO-8601 datetime.' END AS reject_reason
FROM ingest_events
"""


@query("normalize_ts", TS_SQL)
def q_normalize_ts(r):
    """E3 ISO-8601 text to UTC; missing -> fixed 'now'; invalid rejected."""
    return events.normalize_ts(r.ingest_events, _now()).select("source_event_id", "timestamp", "reject_reason")


def _bad_key(path_json, path_text):
    keys = f"json_keys(body, '{path_json}')" if path_json != "$" else "json_keys(body)"
    first = f"list_filter({keys}, lambda k: k LIKE '$%' OR contains(k, '.'))[1]"
    return f"CASE WHEN {first} IS NOT NULL THEN 'Invalid field name ''' || {first} || ''' in {path_text}.' END"


KEYS_SQL = f"""
SELECT source_event_id,
       COALESCE({_bad_key('$', 'payload')}, {_bad_key('$.state', 'payload.state')},
                {_bad_key('$.tags', 'payload.tags')},
                {_bad_key('$.context.items[0]', 'payload.context.items[0]')}) AS reject_reason
FROM ingest_events
"""


@query("validate_keys", KEYS_SQL)
def q_validate_keys(r):
    """E4 reserved-character keys at any depth (Arrow-batched Python walk)."""
    return events.validate_keys(r.ingest_events).select("source_event_id", "reject_reason")


_COLL = (f"CASE {_TYPE} WHEN 'telemetry' THEN 'telemetry_events' WHEN 'alert' THEN 'alert_events' "
         "WHEN 'diagnostic' THEN 'diagnostic_payloads' WHEN 'snapshot' THEN 'simulation_snapshots' "
         "WHEN 'log' THEN 'application_logs' WHEN 'ai_interaction' THEN 'ai_interactions' END")
ROUTE_SQL = f"""
SELECT source_event_id, {_TYPE} AS event_type, {_COLL} AS collection,
       CASE WHEN {_COLL} IS NULL THEN 'Unsupported event type ''' || {_TYPE} || '''.' END AS reject_reason
FROM ingest_events
"""


@query("route_events", ROUTE_SQL)
def q_route_events(r):
    """E6 type -> collection routing."""
    return events.route_events(r.ingest_events).select("source_event_id", "event_type", "collection", "reject_reason")


INGEST_EVENTS_SQL = f"""
WITH v AS ({VALIDATE_SQL}), ro AS ({ROUTE_SQL}), rs AS ({_resolve_sql(True)}), t AS ({TS_SQL}), k AS ({KEYS_SQL})
SELECT e.source_event_id, v.event_type, ro.collection, rs.system_id, rs.system_key, rs.registry_validated,
       t.timestamp, COALESCE(v.reject_reason, ro.reject_reason, rs.reject_reason, t.reject_reason, k.reject_reason)
           AS reject_reason
FROM ingest_events e
JOIN v ON v.source_event_id = e.source_event_id JOIN ro ON ro.source_event_id = e.source_event_id
JOIN rs ON rs.source_event_id = e.source_event_id JOIN t ON t.source_event_id = e.source_event_id
JOIN k ON k.source_event_id = e.source_event_id
"""


@query("ingest_batch", f"""
WITH v AS ({VALIDATE_SQL}), ro AS ({ROUTE_SQL}), rs AS ({_resolve_sql(True)}), t AS ({TS_SQL}), k AS ({KEYS_SQL}),
x AS (SELECT e.batch_id,
             COALESCE(v.reject_reason, ro.reject_reason, rs.reject_reason, t.reject_reason, k.reject_reason) AS why
      FROM ingest_events e
      JOIN v ON v.source_event_id = e.source_event_id JOIN ro ON ro.source_event_id = e.source_event_id
      JOIN rs ON rs.source_event_id = e.source_event_id JOIN t ON t.source_event_id = e.source_event_id
      JOIN k ON k.source_event_id = e.source_event_id)
SELECT batch_id, COUNT(*) AS events, COUNT(*) FILTER (WHERE why IS NULL) AS accepted,
       COUNT(*) FILTER (WHERE why IS NOT NULL) AS rejected
FROM x GROUP BY batch_id
""")
def q_ingest_batch(r):
    """E7 per-request accepted/rejected counts over the whole pipeline."""
    return events.ingest_batch(r.ingest_events, r.systems, _now(), strict=True)


WINDOWED_SQL = """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       event_type, COUNT(*) AS events, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value_sum,
       max(value) AS value_max
FROM events GROUP BY 1, 2, 3
"""


@query("windowed_rollup", WINDOWED_SQL)
def q_windowed_rollup(r):
    """E9 hourly tumbling roll-up per event type."""
    return events.windowed_rollup(r.table("events"), "ts", ["event_type"], "value", "1 hour")


SESSION_SQL = """
WITH o AS (SELECT user_id, ts, value,
                  CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                         OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE
                       THEN 1 ELSE 0 END AS new_session FROM events),
s AS (SELECT *, SUM(new_session) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, COUNT(*) AS events,
       CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value_sum
FROM s GROUP BY user_id, sid
"""


@query("session_rollup", SESSION_SQL)
def q_session_rollup(r):
    """E9 30-minute session windows per user."""
    return events.session_rollup(r.table("events"), "ts", ["user_id"], "value", "30 minutes")


@query("dedupe_events", """
SELECT user_id, event_type, props, ts, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type, props, time_bucket(INTERVAL 1 HOUR, ts)
                               ORDER BY ts, event_id) AS rn FROM events) x
WHERE rn = 1
""")
def q_dedupe_events(r):
    """E10 (batch form) first event per content key and hour."""
    return events.dedupe_events(r.table("events"), ["user_id", "event_type", "props"], "ts", "event_id")


@query("events_per_system", f"""
WITH x AS ({INGEST_EVENTS_SQL})
SELECT x.collection, CAST(x.timestamp AS DATE) AS event_date, x.system_key, x.timestamp,
       sha256(concat_ws('|', CAST(e.source_event_id AS VARCHAR), x.event_type, e.body)) AS event_id
FROM x JOIN ingest_events e ON e.source_event_id = x.source_event_id
WHERE x.reject_reason IS NULL
""")
def q_events_per_system(r):
    """E8 stored events laid out per collection and day, sorted by (system, time desc) inside each partition."""
    x = events.ingest(r.ingest_events, r.systems, _now()).where(C("reject_reason").isNull())
    # cut first: range sampling would otherwise run the whole ingest a second time
    out = cut_lineage(x.select("collection", F.to_date("timestamp").alias("event_date"), "system_key", "timestamp",
                               "event_id"))
    return (out.repartitionByRange("collection", "event_date", "system_key", C("timestamp").desc())
            .sortWithinPartitions("collection", "event_date", "system_key", C("timestamp").desc()))


@query("sliding_rollup", """
WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS window_start, event_type, value FROM events
           UNION ALL
           SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE, event_type, value FROM events)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, COUNT(*) AS events,
       CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value_sum, max(value) AS value_max
FROM w GROUP BY 1, 2, 3
""")
def q_sliding_rollup(r):
    """E9 sliding windows: one hour long, every 30 minutes, per event type."""
    return events.windowed_rollup(r.table("events"), "ts", ["event_type"], "value", "1 hour", slide="30 minutes")


@query("event_rejects", f"""
WITH x AS ({INGEST_EVENTS_SQL})
SELECT x.source_event_id, x.event_type, x.reject_reason, e.body FROM x
JOIN ingest_events e ON e.source_event_id = x.source_event_id WHERE x.reject_reason IS NOT NULL
""")
def q_event_rejects(r):
    """L10 rejected events with reason and body, as the event sink keeps them, read back from its folder."""
    import uuid

    from keelson.session import scratch_path
    from keelson.sources.sinks import event_sink
    path = scratch_path(r.spark, f"event-sink-{uuid.uuid4().hex}")
    event_sink(events.ingest(r.ingest_events, r.systems, _now()), path)
    return r.spark.read.parquet(path + "_rejected").select("source_event_id", "event_type", "reject_reason", "body")
