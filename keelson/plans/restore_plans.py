"""Restore queries (R2-R4) and review decisions in sequence (C6), with oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keelson.operators import changes, restore
from keelson.plans.registry import query
from keelson.session import scratch_path
from keelson.sources.publish import published

C = F.col
MORNING = "morning"


def live(r):
    return {"lots": r.twin_lots, "mirror": r.twin_inventory, "staged": r.twin_positions, "tanks": r.bulk_tanks}


def saved(r):
    return {"lots": r.lot_baseline, "staged": r.staging_baseline, "tanks": r.tank_baseline}


# One row per key of the snapshot: the smallest, column by column.
_LOTS = f"""
saved_lots AS (
  SELECT internal_lot_number AS lot, available_quantity AS q, reserved_quantity AS kept, status AS was,
         CASE lower(status) WHEN 'released' THEN 'available' ELSE status END AS status
  FROM lot_baseline WHERE snapshot_id = '{MORNING}'
  QUALIFY row_number() OVER (PARTITION BY internal_lot_number ORDER BY available_quantity, reserved_quantity, status) = 1)"""


@query("restored_lots", f"""
WITH {_LOTS}
SELECT internal_lot_number, material_code, CAST(coalesce(q, available_quantity) AS DOUBLE) AS available_quantity,
       CAST(coalesce(kept, reserved_quantity) AS DOUBLE) AS reserved_quantity, coalesce(s.status, t.status) AS status
FROM twin_lots t LEFT JOIN saved_lots s ON s.lot = t.internal_lot_number
""")
def q_restored_lots(r):
    """R2 lots of the restored state."""
    return restore.restored_states(live(r), saved(r), MORNING)["lots"]


@query("restored_mirror", f"""
WITH {_LOTS}
SELECT lot_number, CAST(coalesce(q, quantity) AS DOUBLE) AS quantity, CAST(coalesce(kept, reserved_quantity) AS DOUBLE) AS reserved_quantity,
       CASE WHEN s.lot IS NULL THEN qa_status WHEN lower(was) IN ('released', 'available') THEN 'Released'
            ELSE array_to_string(list_transform(string_split(was, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') END AS qa_status
FROM twin_inventory t LEFT JOIN saved_lots s ON s.lot = t.lot_number
""")
def q_restored_mirror(r):
    """R3 the inventory mirror in its own words, any case read alike."""
    return restore.restored_states(live(r), saved(r), MORNING)["mirror"]


_STAGED = "container_id, material_code, lot_number, CAST(quantity AS DOUBLE) AS quantity, location_code"


@query("restored_staged", f"""
SELECT {_STAGED}, status, hazard_class, campaign_id, po_number FROM twin_positions
WHERE location_code IS NULL OR location_code NOT IN ('CW-STAGE-01', 'CW-HAZ-01')
UNION ALL
SELECT {_STAGED}, 'Staged', hazard_class, NULL, NULL FROM staging_baseline WHERE snapshot_id = '{MORNING}'
""")
def q_restored_staged(r):
    """R2 staged positions: those of the snapshot in place of the live ones."""
    return restore.restored_states(live(r), saved(r), MORNING)["staged"]


@query("restored_tanks", f"""
WITH s AS (
  SELECT tank_code, min({{'quantity_kg': quantity_kg, 'qa_status': qa_status, 'lot_number': lot_number,
                          'temperature_c': temperature_c, 'status': status}}) AS v
  FROM tank_baseline WHERE snapshot_id = '{MORNING}' GROUP BY tank_code)
SELECT t.tank_code, material_code, CAST(CASE WHEN v IS NULL THEN t.quantity_kg ELSE v.quantity_kg END AS DOUBLE) AS quantity_kg,
       CASE WHEN v IS NULL THEN t.qa_status ELSE v.qa_status END AS qa_status,
       CASE WHEN v IS NULL THEN t.lot_number ELSE v.lot_number END AS lot_number,
       CAST(CASE WHEN v IS NULL THEN t.temperature_c ELSE v.temperature_c END AS DOUBLE) AS temperature_c,
       CASE WHEN v IS NULL THEN t.status ELSE v.status END AS status
FROM bulk_tanks t LEFT JOIN s USING (tank_code)
""")
def q_restored_tanks(r):
    """R2 tanks of the restored state."""
    return restore.restored_states(live(r), saved(r), MORNING)["tanks"]


_FOUND = """
found AS (
  SELECT 'lots' AS table_name, count(*) AS compared FROM twin_lots WHERE internal_lot_number IN (SELECT lot FROM saved_lots)
  UNION ALL SELECT 'mirror', count(*) FROM twin_inventory WHERE lot_number IN (SELECT lot FROM saved_lots)
  UNION ALL SELECT 'tanks', count(*) FROM bulk_tanks WHERE tank_code IN (SELECT tank_code FROM tank_baseline WHERE snapshot_id = 'morning'))"""


@query("restore_published", f"""
WITH {_LOTS}, {_FOUND}
SELECT table_name, CAST(compared AS BIGINT) AS compared, CAST(0 AS BIGINT) AS mismatches FROM found
UNION ALL
SELECT 'staged', CAST(2 * count(*) AS BIGINT), CAST(0 AS BIGINT) FROM staging_baseline WHERE snapshot_id = '{MORNING}'
""")
def q_restore_published(r):
    """R4 after a published restore: every table agrees with the snapshot, remapped alike."""
    root = scratch_path(r.spark, f"restored-{uuid.uuid4().hex}")
    rows = restore.stored_snapshot(saved(r), MORNING)
    restore.restore_and_publish(live(r), saved(r), MORNING, root, rows)
    states = {name: published(r.spark, root, name) for name in live(r)}
    return restore.compared(states, saved(r), MORNING, rows=rows)


@query("restore_differences", f"""
WITH {_LOTS}, st AS (
  SELECT tank_code, min({{'quantity_kg': quantity_kg, 'qa_status': qa_status, 'lot_number': lot_number,
                          'temperature_c': temperature_c, 'status': status}}) AS v
  FROM tank_baseline WHERE snapshot_id = '{MORNING}' GROUP BY tank_code),
here AS (SELECT container_id, material_code, lot_number, quantity, location_code, hazard_class FROM twin_positions
         WHERE location_code IN ('CW-STAGE-01', 'CW-HAZ-01')),
there AS (SELECT container_id, material_code, lot_number, quantity, location_code, hazard_class FROM staging_baseline
          WHERE snapshot_id = '{MORNING}')
SELECT 'lots' AS table_name, count(*) AS compared,
       count(*) FILTER (WHERE (t.available_quantity, t.reserved_quantity, t.status) IS DISTINCT FROM (q, kept, s.status)) AS mismatches
FROM twin_lots t JOIN saved_lots s ON s.lot = t.internal_lot_number
UNION ALL
SELECT 'mirror', count(*), count(*) FROM twin_inventory t JOIN saved_lots s ON s.lot = t.lot_number
UNION ALL
SELECT 'tanks', count(*), count(*) FROM bulk_tanks JOIN st USING (tank_code)
UNION ALL
SELECT 'staged', (SELECT count(*) FROM here) + (SELECT count(*) FROM there),
       (SELECT count(*) FROM (SELECT * FROM here EXCEPT ALL SELECT * FROM there))
       + (SELECT count(*) FROM (SELECT * FROM there EXCEPT ALL SELECT * FROM here))
""")
def q_restore_differences(r):
    """R4 before a restore: rows of every live table that differ from the snapshot."""
    return restore.compared(live(r), saved(r), MORNING)


# --------------------------------------------------------------------- C6 in sequence
REVIEWED_AT = "2024-02-01 00:00:00"


def _review_sql() -> str:
    """Decisions of one request turn by turn: three rounds, each on the status the round before left."""
    parts = ["at0 AS (SELECT request_id, status, session_id FROM reset_requests)"]
    for k in (1, 2, 3):
        parts.append(f"""
asked{k} AS (
  SELECT d.request_id, d.status AS asked, d.admin_note, d.reviewed_by, a.status AS held, a.session_id,
         CASE WHEN d.status = 'Archived' THEN 'Unsupported reset-request status.'
              WHEN a.request_id IS NULL THEN 'Reset request not found.'
              WHEN d.status = 'Completed' AND a.status <> 'Approved' THEN 'A reset request must be Approved before it can be Completed.'
              WHEN a.status IN ('Rejected', 'Completed') AND a.status <> d.status
              THEN 'Reset request is already terminal (' || a.status || ').' END AS why
  FROM reset_decision_log d LEFT JOIN at{k - 1} a USING (request_id) WHERE d.turn = {k}),
at{k} AS (
  SELECT a.request_id, coalesce(x.asked, a.status) AS status, a.session_id
  FROM at{k - 1} a LEFT JOIN asked{k} x ON x.request_id = a.request_id AND x.why IS NULL)""")
    every = "\n  UNION ALL ".join(f"SELECT *, {k} AS k FROM asked{k}" for k in (1, 2, 3))
    return f"WITH {','.join(parts)},\nlog AS ({every})"


def _reviewed(r):
    now = F.lit(REVIEWED_AT).cast("timestamp_ntz")
    return changes.review_transitions(r.reset_requests, r.reset_decision_log, reviewed_at=now, order=["turn"])


@query("review_sequence", _review_sql() + f""",
taken AS (SELECT request_id, arg_max({{'s': asked, 'n': admin_note, 'b': reviewed_by}}, k) AS v, bool_or(asked IN ('Completed', 'Rejected')) AS ended
          FROM log WHERE why IS NULL GROUP BY request_id)
SELECT q.request_id, q.session_id, coalesce(v.s, q.status) AS status, q.requested_at,
       CASE WHEN ended THEN TIMESTAMP '{REVIEWED_AT}' ELSE q.completed_at END AS completed_at,
       CASE WHEN v IS NULL THEN q.admin_note ELSE v.n END AS admin_note,
       CASE WHEN v IS NULL THEN q.reviewed_by ELSE v.b END AS reviewed_by,
       CASE WHEN v IS NULL THEN q.reviewed_at ELSE TIMESTAMP '{REVIEWED_AT}' END AS reviewed_at
FROM reset_requests q LEFT JOIN taken USING (request_id)
""")
def q_review_sequence(r):
    """C6 requests after up to three decisions each, applied in turn."""
    return _reviewed(r)["state"].select("request_id", "session_id", "status", "requested_at", "completed_at", "admin_note",
                                        "reviewed_by", "reviewed_at")


@query("review_sessions", _review_sql() + """
SELECT session_id, CASE asked WHEN 'Approved' THEN 'Reset Approved' WHEN 'Completed' THEN 'Reset Complete' ELSE 'Reset Rejected' END AS status
FROM log WHERE why IS NULL AND asked IN ('Approved', 'Completed', 'Rejected')
""")
def q_review_sessions(r):
    """C6 session statuses that follow from accepted decisions."""
    return _reviewed(r)["sessions"]


@query("review_rejected", _review_sql() + "\nSELECT request_id, asked AS status, why AS reason FROM log WHERE why IS NOT NULL")
def q_review_rejected(r):
    """C6 decisions that were refused, with the reason."""
    return _reviewed(r)["rejected"]
