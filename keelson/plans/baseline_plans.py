"""Baseline/reconcile (R1-R8) and report (Q1-Q6) queries with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import baseline, reports
from keelson.plans.registry import query

C = F.col
KEPT = ("available", "released", "reserved")
_KEPT_SQL = "('available', 'released', 'reserved')"
SNAP_SQL = f"""
SELECT ml.internal_lot_number, mc.material_code, ml.available_quantity, ml.reserved_quantity, ml.status
FROM material_lots ml JOIN material_catalog mc ON mc.supply_material_id = ml.supply_material_id
WHERE ml.status IN {_KEPT_SQL}
"""


def snap(r):
    return baseline.snapshot(r.material_lots, r.material_catalog, KEPT)


@query("snapshot", f"""
SELECT internal_lot_number, material_code, CAST(available_quantity AS DOUBLE) AS available_quantity,
       CAST(reserved_quantity AS DOUBLE) AS reserved_quantity, status FROM ({SNAP_SQL}) s
""")
def q_snapshot(r):
    """R1 lot baseline refilled from current lots."""
    return snap(r)


RESTORE_SQL = f"""
SELECT l.internal_lot_number, l.material_code,
       CASE WHEN b.internal_lot_number IS NOT NULL THEN b.available_quantity ELSE l.available_quantity END
           AS available_quantity,
       CASE WHEN b.internal_lot_number IS NOT NULL THEN b.reserved_quantity ELSE l.reserved_quantity END
           AS reserved_quantity,
       CASE WHEN b.internal_lot_number IS NOT NULL THEN (CASE WHEN b.status = 'released' THEN 'available'
            ELSE b.status END) ELSE l.status END AS status
FROM live_lots l LEFT JOIN ({SNAP_SQL}) b ON b.internal_lot_number = l.internal_lot_number
"""


@query("restore", f"""
SELECT internal_lot_number, material_code, CAST(available_quantity AS DOUBLE) AS available_quantity,
       CAST(reserved_quantity AS DOUBLE) AS reserved_quantity, status,
       CASE WHEN status IN ('available', 'released') THEN 'Released' ELSE upper(status[1]) || lower(status[2:]) END
           AS mirror_status
FROM ({RESTORE_SQL}) x
""")
def q_restore(r):
    """R2/R3 live lots restored from the baseline, with mirror status."""
    return baseline.restore(r.live_lots, snap(r))


_CMP = ["available_quantity", "reserved_quantity", "status"]
_DIFF = " OR ".join(f"l.{c} IS DISTINCT FROM b.{c}" for c in _CMP)


@query("mismatch_inner", f"""
SELECT COUNT(*) FILTER (WHERE {_DIFF}) AS mismatches, COUNT(*) AS compared
FROM ({SNAP_SQL}) b JOIN live_lots l ON l.internal_lot_number = b.internal_lot_number
""")
def q_mismatch_inner(r):
    """R4 inner: differing rows among keys on both sides."""
    return baseline.mismatch_count(r.live_lots, snap(r), "internal_lot_number", _CMP, "inner")


@query("mismatch_left", f"""
SELECT COUNT(*) FILTER (WHERE l.internal_lot_number IS NULL OR {_DIFF}) AS mismatches, COUNT(*) AS compared
FROM ({SNAP_SQL}) b LEFT JOIN live_lots l ON l.internal_lot_number = b.internal_lot_number
""")
def q_mismatch_left(r):
    """R4 left: differing or missing-from-live baseline rows."""
    return baseline.mismatch_count(r.live_lots, snap(r), "internal_lot_number", _CMP, "left")


def _totals(src):
    return (f"SELECT material_code, COUNT(*) AS row_count, "
            f"CAST(COALESCE(SUM(available_quantity), 0) AS DOUBLE) AS total_available_quantity, "
            f"CAST(COALESCE(SUM(reserved_quantity), 0) AS DOUBLE) AS total_reserved_quantity "
            f"FROM ({src}) t GROUP BY material_code")


_B, _L = _totals(SNAP_SQL), _totals("SELECT * FROM live_lots")


@query("group_diff_one", f"SELECT *, 'baseline_only' AS side FROM (({_B}) EXCEPT ({_L})) d")
def q_group_diff_one(r):
    """R5/U2 per-material totals in the baseline but not in live."""
    return baseline.group_diff(snap(r), r.live_lots, "material_code", ["available_quantity", "reserved_quantity"],
                               both=False)


@query("group_diff_both", f"""
SELECT *, 'baseline_only' AS side FROM (({_B}) EXCEPT ({_L})) d
UNION ALL
SELECT *, 'live_only' AS side FROM (({_L}) EXCEPT ({_B})) e
""", bench=True)
def q_group_diff_both(r):
    """R5/U3 symmetric difference of per-material totals."""
    return baseline.group_diff(snap(r), r.live_lots, "material_code", ["available_quantity", "reserved_quantity"],
                               both=True)


@query("before_after", f"""
SELECT * FROM
 (SELECT COUNT(*) AS rows_before, CAST(COALESCE(SUM(available_quantity), 0) AS DOUBLE) AS qty_before FROM live_lots) a,
 (SELECT COUNT(*) AS rows_after, CAST(COALESCE(SUM(available_quantity), 0) AS DOUBLE) AS qty_after
  FROM ({RESTORE_SQL}) x) z
""")
def q_before_after(r):
    """R6 count and available total before and after the restore."""
    return baseline.before_after(r.live_lots, baseline.restore(r.live_lots, snap(r)), "available_quantity")


@query("verify_counts", f"""
SELECT 'baseline.lots' AS table_name, (SELECT COUNT(*) FROM material_lots WHERE status IN {_KEPT_SQL}) AS expected,
       COUNT(*) AS actual,
       COUNT(*) = (SELECT COUNT(*) FROM material_lots WHERE status IN {_KEPT_SQL}) AS ok
FROM ({SNAP_SQL}) s
""")
def q_verify_counts(r):
    """R8 baseline row count equals the kept live lots."""
    expected = r.material_lots.where(C("status").isin(list(KEPT))).agg(F.count(F.lit(1)).alias("n"))
    return baseline.verify_counts(snap(r), expected, "baseline.lots")


# ------------------------------------------------------------------ reports
@query("session_overview", """
WITH kinds AS (SELECT lower(status) AS kind, count(*) AS n FROM demo_sessions GROUP BY ALL),
asked AS (SELECT lower(status) AS kind, count(*) AS n FROM reset_requests GROUP BY ALL),
waiting AS (SELECT unnest(['requested', 'pending admin reconciliation']) AS kind)
SELECT CAST(coalesce((SELECT sum(n) FROM kinds), 0) AS BIGINT) AS sessions,
       CAST(coalesce((SELECT sum(n) FROM kinds WHERE kind = 'active'), 0) AS BIGINT) AS active_sessions,
       CAST(coalesce((SELECT sum(n) FROM asked WHERE kind = 'approved' OR kind IN (FROM waiting)), 0) AS BIGINT) AS reset_requests,
       CAST(coalesce((SELECT sum(n) FROM asked SEMI JOIN waiting USING (kind)), 0) AS BIGINT) AS pending_reset_requests
""")
def q_session_overview(r):
    """Q1 admin overview counts."""
    return reports.session_overview(r.demo_sessions, r.reset_requests)


@query("session_entities", """
WITH part AS (
  SELECT session_id, count(*) AS n, array_to_string(list_transform(list_sort(list([entity_type, CAST(entity_id AS VARCHAR)])),
                                                                   lambda x: x[1] || ':' || x[2]), ', ') AS line
  FROM demo_session_entities WHERE active GROUP BY ALL)
SELECT session_id, status, created_at, last_seen_at, coalesce(n, 0) AS active_entities, line AS entities
FROM demo_sessions LEFT JOIN part USING (session_id)
""")
def q_session_entities(r):
    """Q2 sessions with ordered active-entity list."""
    return reports.session_entities(r.demo_sessions, r.demo_session_entities)


@query("request_history", """
SELECT request_id, session_id, operator, reason, status, requested_at, completed_at, admin_note, reviewed_by,
       reviewed_at
FROM reset_requests WHERE lower(status) IN ('completed', 'rejected')
""")
def q_request_history(r):
    """Q3 closed reset requests."""
    return reports.request_history(r.reset_requests, closed=True)


@query("open_requests", """
SELECT request_id, session_id, operator, reason, status, requested_at, completed_at, admin_note, reviewed_by,
       reviewed_at
FROM reset_requests WHERE NOT lower(status) IN ('completed', 'rejected')
""")
def q_open_requests(r):
    """Q3 open reset requests."""
    return reports.request_history(r.reset_requests, closed=False)


@query("baseline_status", f"""
WITH a AS (SELECT COUNT(*) FILTER (WHERE lower(status) = 'active') AS n FROM demo_sessions)
SELECT 'lots' AS baseline_name, COUNT(*) AS row_count, (SELECT n FROM a) = 0 AS safe FROM ({SNAP_SQL}) s
UNION ALL
SELECT 'catalog', COUNT(*), (SELECT n FROM a) = 0 FROM material_catalog
UNION ALL
SELECT 'material_totals', COUNT(*), (SELECT n FROM a) = 0 FROM ({_B}) t
""")
def q_baseline_status(r):
    """Q4 baseline row counts and the no-active-session safety flag."""
    b = snap(r)
    return reports.baseline_status(
        {"lots": b, "catalog": r.material_catalog,
         "material_totals": baseline.grouped_totals(b, "material_code", ["available_quantity"])},
        r.demo_sessions)


@query("registry_overview", """
WITH every AS (
  SELECT 's' AS kind, status = 'active' AS live FROM systems
  UNION ALL SELECT 'd', is_active FROM datasets
  UNION ALL SELECT 'r', false FROM dataset_relationships)
SELECT count(*) FILTER (kind = 's') AS systems, count(*) FILTER (kind = 'd') AS datasets, count(*) FILTER (kind = 'r') AS relationships,
       count(*) FILTER (kind = 's' AND live) AS active_systems, count(*) FILTER (kind = 'd' AND live) AS active_datasets
FROM every
""")
def q_registry_overview(r):
    """Q5 registry counts in one row."""
    return reports.registry_overview(r.systems, r.datasets, r.dataset_relationships)


SCAN_KEYS = reports.SECRET_KEY_NAMES + ["token"]


@query("secret_scan", """
WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT source, COUNT(*) AS matching_lines, COUNT(DISTINCT doc_id) AS documents
FROM lines WHERE regexp_matches(line, '([A-Z0-9_]*INGEST_API_KEY|OPENAI_API_KEY|DATABASE_URL|MONGODB_URL|token) ?= ?.{8,}')
GROUP BY source
""")
def q_secret_scan(r):
    """Q6 secret-assignment lines per document source (whole texts, every line)."""
    return reports.secret_scan(r.table("documents"), reports.secret_pattern(SCAN_KEYS, spaced=True))
