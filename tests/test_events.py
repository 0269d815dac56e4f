"""Ingest rules and roll-ups on small frames: identities, prefixes, timestamps, nested keys, batch size."""

import datetime as dt

from pyspark.sql import functions as F

from keelson.operators import events as E

SCHEMA = ("source_event_id long, batch_id string, batch_system_key string, batch_system_id string, raw_type string, "
          "system_key string, system_id string, timestamp_text string, body string")
def NOW_():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def _systems(spark):
    return spark.createDataFrame([(7, "plant-a", "Plant A"), (8, "7", "Odd key")],
                                 "system_id long, system_key string, system_name string")


def test_resolution_rules(spark):
    rows = [(1, "b", "plant-a", None, "telemetry", None, None, None, '{"metric":"m","value":1}'),   # inherited key
            (2, "b", None, None, "EventType.log", None, "7", None, '{"level":"i","message":"x"}'),  # id=7 (key match first)
            (3, "b", None, None, "alert", "bad id!", None, None, '{"severity":"s","message":"x"}'),
            (4, "b", None, None, "alert", "ghost", None, None, '{"severity":"s","message":"x"}'),
            (5, "b", None, None, "alert", "  ", None, None, '{"severity":"s","message":"x"}')]
    df = spark.createDataFrame(rows, SCHEMA)
    strict = {r.source_event_id: r for r in E.resolve_system(df, _systems(spark), strict=True).collect()}
    lenient = {r.source_event_id: r for r in E.resolve_system(df, _systems(spark), strict=False).collect()}
    assert (strict[1].system_id, strict[1].system_name, strict[1].registry_validated) == ("7", "Plant A", True)
    # '7' is system 7's id and system 8's key: id=id comes before key=id in the fixed priority
    assert strict[2].system_key == "plant-a" and strict[2].system_id == "7"
    assert strict[3].reject_reason == "Invalid system identifier."
    assert strict[4].reject_reason == "System is not registered."
    assert lenient[4].reject_reason is None and lenient[4].registry_validated is False
    assert lenient[4].system_name == "ghost"
    assert strict[5].reject_reason == "system_key or system_id is required."


def test_validation_timestamps_keys_and_routing(spark):
    rows = [(1, "b", "k", None, "telemetry", None, None, "2024-01-01T10:00:00Z", '{"metric":"","value":1}'),
            (2, "b", "k", None, "EventType.alert", None, None, "2024-01-01T12:00:00+02:00",
             '{"severity":"s","message":"m","tags":{"a.b":1}}'),
            (3, "b", "k", None, "metrics", None, None, "not-a-time", '{"x":1}'),
            (4, "b", "k", None, "log", None, None, None, '{"level":"i","message":"m","ctx":[{"ok":1},{"$x":2}]}')]
    df = spark.createDataFrame(rows, SCHEMA)
    v = {r.source_event_id: r.reject_reason for r in E.validate_events(df).collect()}
    assert v[1] == "telemetry: metric is required." and v[2] is None
    t = {r.source_event_id: r for r in E.normalize_ts(df, NOW_()).collect()}
    assert t[1].timestamp == dt.datetime(2024, 1, 1, 10) and t[2].timestamp == dt.datetime(2024, 1, 1, 10)
    assert t[3].reject_reason.startswith("timestamp must be") and t[4].timestamp == dt.datetime(2024, 2, 1)
    k = {r.source_event_id: r.reject_reason for r in E.validate_keys(df).collect()}
    assert k[2] == "Invalid field name 'a.b' in payload.tags."
    assert k[4] == "Invalid field name '$x' in payload.ctx[1]."
    r = {x.source_event_id: x for x in E.route_events(df).collect()}
    assert r[2].collection == "alert_events" and r[3].reject_reason == "Unsupported event type 'metrics'."


def test_large_requests_are_taken_whole(spark):
    rows = [(i, "big", "plant-a", None, "log", None, None, None, '{"level":"i","message":"m"}') for i in range(501)]
    out = E.ingest_batch(spark.createDataFrame(rows, SCHEMA), _systems(spark), NOW_()).collect()
    assert [(r.events, r.accepted, r.rejected) for r in out] == [(501, 501, 0)]


def test_broken_bodies_escaped_keys_and_short_times_are_rejected(spark):
    bodies = [("snapshot", "{not json", None), ("snapshot", "[1,2]", None), ("snapshot", None, None),
              ("snapshot", '{"\\u0024set":1}', None), ("snapshot", '{"a\\u002eb":2}', None),
              ("telemetry", '{"metric":"m"}', None), ("snapshot", '{"state":[1]}', None), ("snapshot", '{"tags":"x"}', None),
              ("snapshot", '{"state":{}}', "12:30"), ("snapshot", '{"state":{}}', "2024"),
              ("telemetry", '{"metric":"m","value":null}', "2024-01-01"), ("snapshot", '{"state":{"a":1}}', "2024-01-01T10:00")]
    rows = [(i, "b", "plant-a", None, t, None, None, ts, body) for i, (t, body, ts) in enumerate(bodies)]
    got = {r.source_event_id: r for r in E.ingest(spark.createDataFrame(rows, SCHEMA), _systems(spark), NOW_()).collect()}
    for i in (0, 1, 2):
        assert got[i].reject_reason == "body must be a JSON object."
    assert got[3].reject_reason.startswith("Invalid field name '$set'") and "a.b" in got[4].reject_reason
    assert got[5].reject_reason == "telemetry: value is required."
    assert got[6].reject_reason == "state must be an object." and got[7].reject_reason == "tags must be an object."
    assert got[8].reject_reason == got[9].reject_reason == "timestamp must be a valid ISO-8601 datetime."
    assert got[10].reject_reason is None and got[11].reject_reason is None
    assert got[11].timestamp == dt.datetime(2024, 1, 1, 10) and got[11].payload == '{"state":{"a":1}}'
    v = E.validate_events(spark.createDataFrame(rows, SCHEMA), limits={"metric": 0})
    assert {r.source_event_id for r in v.where("reject_reason like 'metric is longer%'").collect()} == {5, 10}


def test_chunked_sessions_equal_single_pass(spark):
    base = dt.datetime(2024, 1, 1, 23, 50)
    times = [base, base + dt.timedelta(minutes=20), base + dt.timedelta(minutes=45),  # crosses midnight
             base + dt.timedelta(hours=3)]
    hot = [(1, base + dt.timedelta(minutes=10 * i), 1.0) for i in range(600)]  # one hot key, ~4 days
    rows = [(2, t, 2.5) for t in times] + hot
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double")
    chunked = E.session_rollup(df, "ts", ["user_id"], "value", "30 minutes", chunk="day")
    single = E.session_rollup(df, "ts", ["user_id"], "value", "30 minutes", chunk=None)
    assert sorted(map(tuple, chunked.collect())) == sorted(map(tuple, single.collect()))
    u2 = sorted((r.session_start, r.events) for r in chunked.where("user_id = 2").collect())
    assert u2 == [(base, 3), (base + dt.timedelta(hours=3), 1)]
    assert chunked.where("user_id = 1").count() == 1


def test_envelope_body_wins_and_reserved_keys_leave_payload(spark):
    rows = [(1, "b", "plant-a", None, "log", None, None, None,
             '{"level":"i","message":"m","system_name":"from body","event_type":"custom","timestamp":"x","k":1}')]
    df = E.route_events(E.validate_events(spark.createDataFrame(rows, SCHEMA)))
    df = E.resolve_system(df, _systems(spark), strict=True)
    out = E.envelope(df, NOW_()).first()
    assert out.system_name == "from body" and out.event_type == "custom"
    assert "timestamp" not in out.payload and '"k":1' in out.payload and '"level":"i"' in out.payload
