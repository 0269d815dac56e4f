"""Append-mode stream queries (E9, E10) over events that arrive out of order.

Each event reaches the stream some hours after it happened, one in twenty six days after,
and one in three is sent a second time within the day.  The arrivals are cut into BATCHES
equal spans of arrival time and played one after the other.  The SQL states which rows are
late: those the watermark (newest event of all earlier batches, less the delay) has passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators import events as E
from keelson.plans.registry import query
from keelson.streaming.batches import dedupe_within, run_batches

C = F.col
BATCHES, DELAY, GAP = 8, "2 hours", "2 hours"

# Seconds between an event and its arrival, and between an arrival and its repeat; the same
# text is used by both engines.
HELD_BACK = "(event_id * 7919) % 28800 + CASE WHEN event_id % 20 = 0 THEN 6 * 86400 ELSE 0 END"
RESENT = "CASE WHEN event_id % 3 = 0 THEN 1 + (event_id * 104729) % 86400 END"


def arrivals(events: DataFrame, repeats: bool = False) -> DataFrame:
    """``events`` with ``batch``, the arrival span they fall into; ``repeats`` adds those sent twice."""
    at = events.withColumn("arrival", F.unix_micros(C("ts").cast("timestamp")) + F.expr(HELD_BACK) * 1000000)
    if repeats:
        again = at.where(F.expr(RESENT).isNotNull()).withColumn("arrival", C("arrival") + F.expr(RESENT) * 1000000)
        at = at.union(again)
    span = at.agg(F.min("arrival").alias("from"), F.max("arrival").alias("to"))
    batch = F.expr(f"(arrival - `from`) * {BATCHES} div (`to` - `from` + 1)")
    return at.crossJoin(F.broadcast(span)).withColumn("batch", batch.cast("int")).drop("arrival", "from", "to")     # one row


def _arrived_sql(repeats: bool = False) -> str:
    """CTEs: arrived (with batch) and marks (batch, the watermark before it, the watermark after it)."""
    first = f"SELECT *, epoch_us(ts) + ({HELD_BACK}) * 1000000 AS arrival FROM events"
    again = f" UNION ALL SELECT * REPLACE (arrival + ({RESENT}) * 1000000 AS arrival) FROM once WHERE event_id % 3 = 0" if repeats else ""
    return f"""
once AS ({first}), sent AS (SELECT * FROM once{again}),
arrived AS (
  SELECT *, (arrival - min(arrival) OVER ()) * {BATCHES} // (max(arrival) OVER () - min(arrival) OVER () + 1) AS batch FROM sent),
newest AS (SELECT batch, date_trunc('milliseconds', max(ts)) AS top FROM arrived GROUP BY batch),
marks AS (
  SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL {DELAY} AS before,
         max(top) OVER (ORDER BY batch) - INTERVAL {DELAY} AS after FROM newest)"""


@query("windowed_rollup_append", f"""
WITH {_arrived_sql()},
kept AS (
  SELECT event_type, value, date_trunc('hour', ts) AS window_start FROM arrived JOIN marks USING (batch)
  WHERE before IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > before)
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS events,
       CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value_sum, max(value) AS value_max
FROM kept GROUP BY window_start, event_type
HAVING window_start + INTERVAL 1 HOUR <= (SELECT max(after) FROM marks)
""")
def q_windowed_rollup_append(r):
    """E9 hourly windows, each emitted once when the watermark passes its end; late rows dropped."""
    return run_batches(arrivals(r.table("events")), "batch",
                       lambda s: E.windowed_rollup(s, "ts", ["event_type"], "value", "1 hour", watermark=DELAY),
                       "windowed_rollup_append")[0]


def _session_sql() -> str:
    """Sessions batch by batch: open ones and new rows merge, those the watermark has passed leave."""
    parts = [_arrived_sql(), """
held AS (SELECT -1 AS batch, CAST(NULL AS BIGINT) AS user_id, CAST(NULL AS TIMESTAMP) AS s, CAST(NULL AS TIMESTAMP) AS e,
                CAST(NULL AS BIGINT) AS n, CAST(NULL AS DECIMAL(38,4)) AS v WHERE false)"""]
    last = "held"
    for k in range(BATCHES):
        parts.append(f"""
in{k} AS (
  SELECT user_id, s, e, n, v FROM {last}
  UNION ALL
  SELECT user_id, ts, ts + INTERVAL {GAP}, 1, CAST(value AS DECIMAL(18,4)) FROM arrived JOIN marks USING (batch)
  WHERE batch = {k} AND (before IS NULL OR ts + INTERVAL {GAP} > before)),
cut{k} AS (
  SELECT *, coalesce(s >= max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens
  FROM in{k}),
run{k} AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM cut{k}),
all{k} AS (
  SELECT user_id, min(s) AS s, max(e) AS e, CAST(sum(n) AS BIGINT) AS n, sum(v) AS v,
         max(e) <= (SELECT max(after) FROM marks WHERE batch <= {k}) AS done
  FROM run{k} GROUP BY user_id, g),
left{k} AS (SELECT user_id, s, e, n, v FROM all{k} WHERE done IS NOT TRUE)""")
        last = f"left{k}"
    out = "\nUNION ALL ".join(
        f"SELECT s AS session_start, e AS session_end, user_id, n AS events, CAST(v AS DOUBLE) AS value_sum FROM all{k} WHERE done"
        for k in range(BATCHES))
    return f"WITH {','.join(parts)}\n{out}"


@query("session_rollup_append", _session_sql())
def q_session_rollup_append(r):
    """E9 sessions per user that leave the state, and are emitted, when the watermark passes their end."""
    return run_batches(arrivals(r.table("events")), "batch",
                       lambda s: E.session_rollup(s, "ts", ["user_id"], "value", GAP, watermark=DELAY),
                       "session_rollup_append")[0]


@query("dedupe_within_watermark", f"""
WITH {_arrived_sql(repeats=True)},
first AS (SELECT event_id, min(batch) AS batch FROM arrived GROUP BY event_id)
SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value
FROM events e JOIN first USING (event_id) JOIN marks USING (batch) WHERE before IS NULL OR e.ts > before
""")
def q_dedupe_within_watermark(r):
    """E10 events sent twice: one row per event whose first arrival is in time; keys expire."""
    out, _ = run_batches(arrivals(r.table("events"), repeats=True), "batch",
                         lambda s: dedupe_within(s, ["event_id"], "ts", DELAY), "dedupe_within_watermark")
    return out.select("event_id", "ts", "user_id", "event_type", "value")
