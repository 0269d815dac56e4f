"""Structured Streaming queries: each runs a stream over the driver table's file
(``availableNow`` into parquet under the shared checkpoint folder) and returns the
result table, so the streaming engine's answers go through the same oracles as
the batch forms.

The roll-ups here use complete mode with a watermark wider than the data so
every window is final and comparable with the batch answer.  A long-running
job uses append mode with a short watermark (the defaults of
``keelson.streaming.events``), which keeps state bounded: a window is emitted
once and dropped when the watermark passes its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.plans import event_plans, telemetry_plans
from keelson.plans.registry import query
from keelson.streaming import events as S

C = F.col


def whole_span(events: DataFrame, column: str) -> str:
    """A watermark as wide as the table: no row is late, in whatever order and number of batches rows arrive."""
    at = C(column).cast("timestamp").cast("long")
    span = events.agg(F.max(at) - F.min(at)).first()[0]
    return f"{(span or 0) + 7200} seconds"      # the start of an hour lies before its events


@query("windowed_rollup_stream", event_plans.WINDOWED_SQL)
def q_windowed_rollup_stream(r):
    """E9 hourly tumbling roll-up computed by Structured Streaming (watermarked)."""
    out = S.windowed_rollup_stream(r.stream("events"), "1 hour", whole_span(r.table("events"), "ts"))
    return S.run_to_table(out, "windowed_rollup_stream", mode="complete")


@query("session_rollup_stream", event_plans.SESSION_SQL)
def q_session_rollup_stream(r):
    """E9 30-minute session windows per user computed by Structured Streaming."""
    out = S.session_rollup_stream(r.stream("events"), "30 minutes", whole_span(r.table("events"), "ts"))
    return S.run_to_table(out, "session_rollup_stream", mode="complete")


@query("dedupe_events_stream", """
SELECT DISTINCT user_id, event_type, props, date_trunc('hour', ts) AS window_start FROM events
""")
def q_dedupe_events_stream(r):
    """E10 streaming dedupe: one event per content key and hour, as the batch form keeps."""
    out = S.dedupe_stream(r.stream("events"), ["user_id", "event_type", "props"],
                          watermark=whole_span(r.table("events"), "ts"))
    return S.run_to_table(out, "dedupe_events_stream").select("user_id", "event_type", "props", "window_start")


@query("grid_snapshot_stream", telemetry_plans.GRID_SQL)
def q_grid_snapshot_stream(r):
    """V19-V21 on a stream: metrics per reading, hourly grid snapshot (watermarked)."""
    out = S.grid_snapshot_stream(r.stream("telemetry_readings"), r.assets, "1 hour",
                                 whole_span(r.telemetry_readings, "recorded_at"))
    return S.run_to_table(out, "grid_snapshot_stream", mode="complete")


@query("ingest_stream", event_plans.INGEST_EVENTS_SQL)
def q_ingest_stream(r):
    """E1-E6 on a stream (stream-static registry join): per-event routing and reject reasons."""
    now = F.lit(event_plans.NOW).cast("timestamp_ntz")
    out = S.ingest_stream(r.stream("ingest_events"), r.systems, now).select(
        "source_event_id", "event_type", "collection", "system_id", "system_key", "registry_validated",
        "timestamp", "reject_reason")
    return S.run_to_table(out, "ingest_stream")
