"""KPI queries (V1-V18) over the role binding, with their DuckDB oracles.

The oracles are put together from PARTS: one common table expression per child
table, each with one row per parent, joined to the parent at the end.
"""

from __future__ import annotations

from keelson.functions.numeric import sql_round_ratio as rr
from keelson.functions.numeric import sql_unscaled as us
from keelson.operators import kpi
from keelson.plans.registry import query

D = lambda e: f"CAST({e} AS DOUBLE)"


def _minutes(a, b):
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {rr(f'epoch_us({b}) - epoch_us({a})', '60000000', 2)} END"


def _v1_args(r):
    return (r.batches, r.production_orders, r.products, r.process_runs, r.deviations, r.quality_results)


# --------------------------------------------------------------------- oracle parts
def _share(part, whole):
    """Percent of ``whole``, NULL where there is none."""
    return f"CASE WHEN {whole} > 0 THEN {rr(part, whole, 2, 100)} END"


PARTS = {
    "head": """SELECT b.*, o.po_number, p.product_code, p.product_name
  FROM batches b JOIN (SELECT production_order_id, po_number FROM production_orders) o USING (production_order_id)
       JOIN (SELECT product_id, product_code, product_name FROM products) p USING (product_id)""",
    "ran": """SELECT batch_id, count(DISTINCT process_run_id) AS runs,
         count(DISTINCT process_run_id) FILTER (status = 'completed') AS finished
  FROM process_runs GROUP BY ALL""",
    "deviated": """SELECT batch_id, count(DISTINCT deviation_id) AS deviations,
         count(DISTINCT deviation_id) FILTER (status <> 'closed' AND status <> 'cancelled') AS unsettled
  FROM deviations GROUP BY ALL""",
    "tested": """SELECT batch_id, count(DISTINCT quality_result_id) AS tests,
         count(DISTINCT quality_result_id) FILTER (disposition = 'pass') AS good,
         count(DISTINCT quality_result_id) FILTER (disposition = 'fail') AS poor
  FROM quality_results GROUP BY ALL""",
    "measured": """SELECT batch_id, count(*) AS points, count(*) FILTER (within_spec) AS inside, count(*) FILTER (NOT within_spec) AS outside
  FROM process_parameters JOIN (SELECT process_run_id, batch_id, process_step_id FROM process_runs) USING (process_run_id)
  WHERE batch_id IN (SELECT batch_id FROM batches) AND process_step_id IN (SELECT process_step_id FROM process_steps)
  GROUP BY ALL""",
    "packed": """SELECT batch_id, sum(target_units) AS planned, sum(produced_units) AS made, sum(rejected_units) AS spoilt
  FROM packaging_records GROUP BY ALL""",
    "weighed": """SELECT batch_id, count(*) AS lines, count(*) FILTER (weighing_status = 'verified') AS verified
  FROM batch_materials GROUP BY ALL""",
    "place": "SELECT equipment_id, equipment_code, equipment_name, equipment_type FROM equipment",
    "step": "SELECT process_step_id, sequence_number, step_code, step_name, step_type, target_duration_seconds FROM process_steps",
    "name": "SELECT batch_id, batch_number FROM batches",
}


def _with(*parts, then):
    return "WITH " + ",\n".join(f"{p} AS (\n  {PARTS[p]})" for p in parts) + f"\n{then}"


_HEAD = f"""batch_id, batch_number, po_number, product_code, product_name, status AS batch_status,
       {D('target_quantity')} AS target_quantity, {D('actual_quantity')} AS actual_quantity"""
_CHILDREN = "FROM head LEFT JOIN ran USING (batch_id) LEFT JOIN deviated USING (batch_id) LEFT JOIN tested USING (batch_id)"
_YIELD = _share(us('coalesce(actual_quantity, 0)'), us('target_quantity'))


# --------------------------------------------------------------------- V1
V1_SQL = _with("head", "ran", "deviated", "tested", then=f"""
SELECT {_HEAD}, unit_of_measure, {_YIELD} AS batch_yield_pct, started_at, completed_at, released_at,
       {_minutes('started_at', 'completed_at')} AS cycle_time_minutes,
       coalesce(runs, 0) AS process_runs, coalesce(finished, 0) AS completed_process_runs,
       coalesce(deviations, 0) AS deviation_count, coalesce(unsettled, 0) AS open_deviations,
       coalesce(tests, 0) AS quality_tests, coalesce(good, 0) AS quality_passes, coalesce(poor, 0) AS quality_failures
{_CHILDREN}""")


# Run, deviation and result ids are primary keys in the model (line ids are
# unique in the binding -- tests/test_properties.py checks it), so distinct
# counts are row counts; the oracle still computes COUNT(DISTINCT ...).
PK_IDS = True


@query("batch_kpis", V1_SQL, bench=True)
def q_batch_kpis(r):
    """V1 batch KPIs, pre-aggregated children."""
    return kpi.batch_kpis(*_v1_args(r), unique_ids=PK_IDS)


@query("batch_kpis_exact", V1_SQL)
def q_batch_kpis_exact(r):
    """V1 batch KPIs with exact distinct counts, for ids that may repeat."""
    return kpi.batch_kpis(*_v1_args(r), unique_ids=False)


@query("batch_process_summary", _with("head", "ran", "deviated", "tested", then=f"""
SELECT {_HEAD}, unit_of_measure, started_at, completed_at, released_at, coalesce(runs, 0) AS process_run_count,
       coalesce(finished, 0) AS completed_process_runs, coalesce(deviations, 0) AS deviation_count,
       coalesce(poor, 0) AS failed_quality_tests
{_CHILDREN}"""))
def q_batch_process_summary(r):
    """V11 batch process summary."""
    return kpi.batch_process_summary(*_v1_args(r), unique_ids=PK_IDS)


# --------------------------------------------------------------------- V2-V8
@query("process_performance", _with("name", "step", "place", then=f"""
SELECT batch_id, batch_number, sequence_number, step_code, step_name, step_type, process_run_id, run_number,
       r.status AS run_status, equipment_code, equipment_name, equipment_type, target_duration_seconds,
       actual_duration_seconds, {_share('actual_duration_seconds', 'target_duration_seconds')} AS duration_vs_target_pct,
       actual_duration_seconds - target_duration_seconds AS duration_variance_seconds, started_at, completed_at, operator_name
FROM name JOIN process_runs r USING (batch_id) JOIN step USING (process_step_id) LEFT JOIN place USING (equipment_id)"""))
def q_process_performance(r):
    """V2 run timing vs target."""
    return kpi.process_performance(r.process_runs, r.batches, r.process_steps, r.equipment)


V3_SQL = _with("name", "step", "place", then=f"""
SELECT batch_id, batch_number, step_name, process_run_id, equipment_code, parameter_name, parameter_type,
       {D('target_value')} AS target_value, {D('actual_value')} AS actual_value, {D('lower_limit')} AS lower_limit,
       {D('upper_limit')} AS upper_limit, unit_of_measure, within_spec,
       coalesce(map {{true: 'in-spec', false: 'out-of-spec'}}[within_spec], 'unknown') AS conformance_status,
       {D('actual_value - target_value')} AS deviation_from_target, recorded_at
FROM process_parameters JOIN (SELECT process_run_id, batch_id, process_step_id, equipment_id FROM process_runs) USING (process_run_id)
     JOIN name USING (batch_id) JOIN step USING (process_step_id) LEFT JOIN place USING (equipment_id)""")


@query("cpp_performance", V3_SQL)
def q_cpp_performance(r):
    """V3 CPP conformance."""
    return kpi.cpp_performance(r.process_parameters, r.process_runs, r.batches, r.process_steps, r.equipment)


V4_SQL = _with("name", then=f"""
SELECT batch_id, batch_number, quality_result_id, test_name, test_method, sample_id, {D('result_numeric')} AS result_numeric,
       result_text, {D('lower_spec_limit')} AS lower_spec_limit, {D('upper_spec_limit')} AS upper_spec_limit, unit_of_measure,
       disposition, CASE WHEN disposition IN ('pass', 'fail') THEN disposition = 'pass' END AS passed, tested_at, analyst_name
FROM name JOIN quality_results USING (batch_id)""")


@query("quality_performance", V4_SQL)
def q_quality_performance(r):
    """V4 quality results with three-valued pass flag."""
    return kpi.quality_performance(r.quality_results, r.batches)


@query("deviation_summary", _with("name", "step", "place", then=f"""
SELECT batch_id, batch_number, deviation_id, deviation_number, severity, category, description, status, opened_at, closed_at,
       {_minutes('opened_at', 'closed_at')} AS resolution_minutes, root_cause, corrective_action, equipment_code, step_name
FROM (SELECT * RENAME (batch_id AS of_batch) FROM deviations)
     LEFT JOIN name ON batch_id = of_batch LEFT JOIN place USING (equipment_id)
     LEFT JOIN (SELECT process_run_id, step_name FROM process_runs JOIN step USING (process_step_id)) USING (process_run_id)"""))
def q_deviation_summary(r):
    """V5 deviations with optional context."""
    return kpi.deviation_summary(r.deviations, r.batches, r.equipment, r.process_runs, r.process_steps)


@query("packaging_performance", _with("name", "place", then=f"""
SELECT batch_id, batch_number, packaging_record_id, packaging_line, package_type, target_units, produced_units, rejected_units,
       {_share('produced_units', 'target_units')} AS packaging_yield_pct,
       CASE WHEN coalesce(produced_units, 0) + coalesce(rejected_units, 0) > 0
            THEN {rr('rejected_units', '(produced_units + rejected_units)', 2, 100)} END AS reject_rate_pct,
       status, started_at, completed_at, equipment_code, equipment_name
FROM name JOIN packaging_records USING (batch_id) LEFT JOIN place USING (equipment_id)"""))
def q_packaging_performance(r):
    """V6 packaging yield and reject rate."""
    return kpi.packaging_performance(r.packaging_records, r.batches, r.equipment)


@query("material_performance", _with("name", then=f"""
SELECT batch_id, batch_number, material_code, material_name, {D('required_quantity')} AS required_quantity,
       {D('actual_quantity')} AS actual_quantity, line.unit_of_measure,
       {_share(us('coalesce(actual_quantity, 0)'), us('required_quantity'))} AS fulfillment_pct, weighing_status,
       internal_lot_number, request_number, asked.status AS supply_line_status, weighed_at
FROM name JOIN batch_materials line USING (batch_id)
     JOIN (SELECT material_id, material_code, material_name FROM materials) USING (material_id)
     LEFT JOIN (SELECT material_lot_id AS supply_material_lot_id, internal_lot_number FROM material_lots) USING (supply_material_lot_id)
     LEFT JOIN (SELECT pharma_batch_material_id AS batch_material_id, l.status, q.request_number
                FROM material_request_lines l LEFT JOIN material_requests q USING (material_request_id)) asked USING (batch_material_id)"""))
def q_material_performance(r):
    """V7 material fulfilment per batch material."""
    return kpi.material_performance(r.batch_materials, r.batches, r.materials, r.material_lots,
                                    r.material_request_lines, r.material_requests)


def _v8_sql(fanout: bool) -> str:
    """Runs and deviations reduced per equipment; with ``fanout`` each run counts once per deviation of its equipment."""
    times = "greatest(coalesce(rows_, 0), 1)" if fanout else "1"
    return f"""
WITH used AS (
  SELECT equipment_id, count(process_run_id) AS runs, count(*) FILTER (status = 'completed') AS finished, count(*) FILTER (status = 'failed') AS broken,
         sum(actual_duration_seconds) AS seconds, count(actual_duration_seconds) AS timed
  FROM process_runs GROUP BY ALL),
faults AS (SELECT equipment_id, count(DISTINCT deviation_id) AS deviations, count(*) AS rows_ FROM deviations GROUP BY ALL),
both_ AS (
  SELECT e.*, coalesce(runs, 0) * {times} AS n, coalesce(finished, 0) * {times} AS c, coalesce(broken, 0) * {times} AS f,
         coalesce(seconds, 0) * {times} AS s, coalesce(timed, 0) * {times} AS k, coalesce(deviations, 0) AS d
  FROM equipment e LEFT JOIN used USING (equipment_id) LEFT JOIN faults USING (equipment_id))
SELECT equipment_id, equipment_code, equipment_name, equipment_type, area, status AS equipment_status,
       CAST(n AS BIGINT) AS total_runs, CAST(c AS BIGINT) AS completed_runs, CAST(f AS BIGINT) AS failed_runs,
       CAST(s AS BIGINT) AS total_runtime_seconds, CASE WHEN k > 0 THEN {rr('s', 'k', 2)} ELSE 0.0::DOUBLE END AS average_run_seconds,
       CAST(d AS BIGINT) AS deviation_count, last_calibration_at, next_calibration_due
FROM both_"""


@query("equipment_performance", _v8_sql(True), bench=True)
def q_equipment_performance(r):
    """V8 equipment figures with the reference's fan-out counting."""
    return kpi.equipment_performance(r.equipment, r.process_runs, r.deviations, fanout=True, unique_ids=PK_IDS)


@query("equipment_performance_true", _v8_sql(False))
def q_equipment_performance_true(r):
    """V8 with true (non fan-out) run counts."""
    return kpi.equipment_performance(r.equipment, r.process_runs, r.deviations, fanout=False, unique_ids=PK_IDS)


# --------------------------------------------------------------------- V9 / V10
V9_SQL = _with("head", "ran", "deviated", "tested", "measured", "packed", "weighed", then=f"""
SELECT {_HEAD}, {_YIELD} AS batch_yield_pct, {_minutes('started_at', 'completed_at')} AS cycle_time_minutes,
       coalesce(runs, 0) AS process_runs, coalesce(finished, 0) AS completed_process_runs,
       coalesce(deviations, 0) AS deviation_count, coalesce(unsettled, 0) AS open_deviations,
       coalesce(points, 0) AS cpp_count, CAST(coalesce(inside, 0) AS BIGINT) AS cpp_in_spec,
       CAST(coalesce(outside, 0) AS BIGINT) AS cpp_out_of_spec, {_share('inside', 'points')} AS cpp_conformance_pct,
       coalesce(tests, 0) AS quality_test_count, coalesce(good, 0) AS quality_pass_count, coalesce(poor, 0) AS quality_fail_count,
       {_share('good', 'tests')} AS quality_pass_rate_pct,
       CAST(coalesce(planned, 0) AS BIGINT) AS packaging_target_units, CAST(coalesce(made, 0) AS BIGINT) AS packaging_produced_units,
       CAST(coalesce(spoilt, 0) AS BIGINT) AS packaging_rejected_units,
       CASE WHEN coalesce(made, 0) + coalesce(spoilt, 0) > 0 THEN {rr('spoilt', '(made + spoilt)', 2, 100)} END AS packaging_reject_rate_pct,
       coalesce(lines, 0) AS material_count, CAST(coalesce(verified, 0) AS BIGINT) AS verified_material_count,
       {_share('verified', 'lines')} AS material_fulfillment_pct, started_at, completed_at, released_at
{_CHILDREN} LEFT JOIN measured USING (batch_id) LEFT JOIN packed USING (batch_id) LEFT JOIN weighed USING (batch_id)""")


def dashboard(r):
    return kpi.dashboard_in_one(r.batches, r.production_orders, r.products, r.process_runs, r.deviations, r.process_parameters,
                                r.process_steps, r.quality_results, r.packaging_records, r.batch_materials)


@query("production_dashboard", V9_SQL, bench=True)
def q_production_dashboard(r):
    """V9 production dashboard (flagship)."""
    return dashboard(r)


@query("production_dashboard_exact", V9_SQL)
def q_production_dashboard_exact(r):
    """V9 on exact distinct counts, for ids that may repeat."""
    bk = kpi.batch_kpis(*_v1_args(r), unique_ids=False)
    return kpi.production_dashboard(bk, r.process_parameters, r.process_runs, r.process_steps,
                                    r.quality_results, r.packaging_records, r.batch_materials)


@query("process_health", f"""
SELECT *, coalesce(CASE WHEN open_deviations > 0 THEN 'attention' END, CASE WHEN quality_fail_count > 0 THEN 'critical' END,
                   CASE WHEN cpp_out_of_spec > 0 THEN 'warning' END,
                   CASE WHEN batch_status = 'released' THEN 'healthy' ELSE 'in-process' END) AS process_health_status
FROM ({V9_SQL})
""")
def q_process_health(r):
    """V10 process health badge."""
    return kpi.process_health(dashboard(r))


# --------------------------------------------------------------------- V12-V18
@query("material_availability", """
WITH stock AS (
  SELECT supply_material_id, count(material_lot_id) AS lots, sum(available_quantity) AS free, sum(reserved_quantity) AS held
  FROM material_lots WHERE status = ANY (['released', 'reserved', 'available']) GROUP BY ALL)
SELECT supply_material_id, material_code, material_name, material_type, unit_of_measure, coalesce(lots, 0) AS lot_count,
       CAST(coalesce(free, 0) AS DOUBLE) AS available_quantity, CAST(coalesce(held, 0) AS DOUBLE) AS reserved_quantity,
       CAST(reorder_point AS DOUBLE) AS reorder_point, CAST(reorder_quantity AS DOUBLE) AS reorder_quantity,
       coalesce(reorder_point, 0) >= coalesce(free, 0) AS reorder_required
FROM material_catalog LEFT JOIN stock USING (supply_material_id)
""", bench=True)
def q_material_availability(r):
    """V12 material availability and reorder flag."""
    return kpi.material_availability(r.material_catalog, r.material_lots)


@query("material_fulfillment", """
WITH line AS (
  SELECT material_request_id, material_code, material_name, l.unit_of_measure, l.status AS line_status,
         CAST(requested_quantity AS DOUBLE) AS requested_quantity, CAST(reserved_quantity AS DOUBLE) AS reserved_quantity,
         CAST(issued_quantity AS DOUBLE) AS issued_quantity
  FROM material_request_lines l JOIN material_catalog USING (supply_material_id)),
made AS (SELECT batch_id, batch_number, product_code, product_name FROM batches LEFT JOIN products USING (product_id))
SELECT material_request_id, request_number, correlation_id, po_number, batch_id, batch_number, product_code, product_name,
       material_code, material_name, requested_quantity, reserved_quantity, issued_quantity, line.unit_of_measure, line_status,
       q.status AS request_status
FROM line JOIN material_requests q USING (material_request_id) LEFT JOIN made ON batch_id = pharma_batch_id
     LEFT JOIN production_orders ON production_order_id = pharma_production_order_id
""")
def q_material_fulfillment(r):
    """V13 request-line fulfilment context."""
    return kpi.material_fulfillment(r.material_requests, r.production_orders, r.batches, r.products,
                                    r.material_request_lines, r.material_catalog)


_COUNTED = [("pharma.products", "products"), ("pharma.materials", "materials"),
            ("pharma.production_orders", "production_orders"), ("pharma.batches", "batches"),
            ("pharma.batch_materials", "batch_materials"), ("pharma.process_runs", "process_runs"),
            ("pharma.process_parameters", "process_parameters"), ("pharma.packaging_records", "packaging_records"),
            ("pharma.quality_results", "quality_results"), ("pharma.deviations", "deviations"),
            ("supply.suppliers", "suppliers"), ("supply.material_catalog", "material_catalog"),
            ("supply.material_lots", "material_lots"), ("supply.material_requests", "material_requests"),
            ("supply.material_request_lines", "material_request_lines"),
            ("supply.material_reservations", "material_reservations"),
            ("supply.weighing_transactions", "weighing_transactions"), ("supply.material_issues", "material_issues")]


@query("row_counts", "\nUNION ALL ".join(
    f"SELECT '{label}' AS object_name, COUNT(*) AS row_count FROM {role}" for label, role in _COUNTED))
def q_row_counts(r):
    """V14 row count per model table, one scan per driver table (roles are filtered views)."""
    from pyspark.sql import functions as F
    from keelson.plans.roles import ROLES
    by_source: dict = {}
    separate = {}
    for label, role in _COUNTED:
        spec = ROLES[role]
        if spec.distinct or spec.prelude:  # not a plain filtered view: count it on its own
            separate[label] = r[role]
            continue
        by_source.setdefault(spec.source, {})[label] = F.expr(spec.where) if spec.where else F.lit(True)
    out = kpi.row_counts_shared_scan([(r.table(src), counted) for src, counted in by_source.items()])
    return out.unionByName(kpi.row_counts(separate)) if separate else out


@query("lots_per_material", """
WITH label AS (SELECT supply_material_id, material_code, material_name, unit_of_measure FROM material_catalog),
lot AS (SELECT supply_material_id, available_quantity, reserved_quantity, material_lot_id FROM material_lots)
SELECT material_code, material_name, count(material_lot_id) AS lot_count, CAST(sum(available_quantity) AS DOUBLE) AS available_quantity,
       CAST(sum(reserved_quantity) AS DOUBLE) AS reserved_quantity, unit_of_measure
FROM label LEFT JOIN lot USING (supply_material_id) GROUP BY ALL
""")
def q_lots_per_material(r):
    """V15 lots per material over the whole catalog."""
    return kpi.lots_per_material(r.material_catalog, r.material_lots)


@query("traceability", """
WITH need AS (
  SELECT batch_material_id, batch_id, material_id, material_lot, CAST(required_quantity AS DOUBLE) AS required_quantity,
         CAST(actual_quantity AS DOUBLE) AS actual_quantity, unit_of_measure, weighing_status
  FROM batch_materials),
told AS (
  SELECT l.pharma_batch_material_id AS batch_material_id, q.request_number, v.status AS reservation_status
  FROM material_request_lines l LEFT JOIN material_requests q USING (material_request_id)
       LEFT JOIN material_reservations v USING (material_request_line_id)),
scale AS (SELECT pharma_batch_material_id AS batch_material_id, status AS weighing_status_supply, tare_confirmed FROM weighing_transactions),
sent AS (SELECT pharma_batch_material_id AS batch_material_id, material_issue_id FROM material_issues)
SELECT batch_number, po_number AS pharma_po, material_code, material_name, material_lot, required_quantity, actual_quantity,
       need.unit_of_measure, weighing_status, request_number, reservation_status, weighing_status_supply, tare_confirmed,
       material_issue_id IS NOT NULL AS issued_to_pharma
FROM need JOIN (SELECT batch_id, batch_number, po_number FROM batches JOIN production_orders USING (production_order_id)) USING (batch_id)
     JOIN (SELECT material_id, material_code, material_name FROM materials) USING (material_id)
     LEFT JOIN told USING (batch_material_id) LEFT JOIN scale USING (batch_material_id) LEFT JOIN sent USING (batch_material_id)
""")
def q_traceability(r):
    """V16 end-to-end traceability for every batch material."""
    return kpi.traceability(r.batch_materials, r.batches, r.production_orders, r.materials,
                            r.material_request_lines, r.material_requests, r.material_reservations,
                            r.weighing_transactions, r.material_issues)


@query("lot_assignment_check", """
WITH family AS (SELECT batch_id, batch_number FROM batches WHERE starts_with(batch_number, 'B-'))
SELECT batch_number, material_code, material_name, material_lot, weighing_status
FROM family JOIN batch_materials USING (batch_id) JOIN (SELECT material_id, material_code, material_name FROM materials) USING (material_id)
""")
def q_lot_assignment_check(r):
    """V18 lot listing for the 'B-' batch family (every batch in this binding)."""
    return kpi.lot_assignment_check(r.batch_materials, r.batches, r.materials, "B-%")
