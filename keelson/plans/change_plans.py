"""Ordered selection (W1, W2, V17) and change-application (C1-C11) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import changes, selection
from keelson.plans.registry import query

C = F.col

# ------------------------------------------------------------------ selection
# The lot that expires first, by its lot number among equals, with the columns of the material it belongs to.
FEFO_SQL = """
WITH best AS (
  SELECT supply_material_id, min({'expiry_date': expiry_date, 'internal_lot_number': internal_lot_number, 'material_lot_id': material_lot_id}) AS lot
  FROM material_lots WHERE status = 'released' GROUP BY supply_material_id)
SELECT material_code, arg_min(supply_material_id, lot) AS supply_material_id, min(lot).material_lot_id AS material_lot_id,
       min(lot).internal_lot_number AS internal_lot_number, min(lot).expiry_date AS expiry_date
FROM best JOIN material_catalog USING (supply_material_id) GROUP BY material_code
"""


@query("fefo_lot_choice", FEFO_SQL)
def q_fefo(r):
    """W1 first-expiry released lot per material."""
    return selection.fefo_lot_choice(r.material_catalog, r.material_lots)


LATERAL_SQL = """
WITH second AS (
  SELECT supply_material_id, min(internal_lot_number) AS internal_lot_number, arg_min(material_lot_id, internal_lot_number) AS material_lot_id
  FROM material_lots WHERE ends_with(internal_lot_number, '-02') GROUP BY supply_material_id)
SELECT material_code, supply_material_id, material_lot_id, internal_lot_number
FROM second JOIN (SELECT supply_material_id, material_code FROM material_catalog) USING (supply_material_id)
"""


@query("lateral_top1", LATERAL_SQL)
def q_lateral_top1(r):
    """W2 lowest '-02' lot per material."""
    return selection.lateral_top1(r.material_catalog, r.material_lots)


RECIPE_FACTORS = {"released": 0.9985, "mixing": 1.0008}


def recipe_of(r):
    """Bill of materials per product: every material its customer ever ordered, smallest quantity."""
    o = r.table("orders").select("o_orderkey", "o_custkey")
    li = r.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return (li.join(o, C("l_orderkey") == C("o_orderkey"))
            .groupBy(C("o_custkey").alias("product_id"), C("l_partkey"))
            .agg(F.min("l_quantity").cast("decimal(18,4)").alias("required_quantity"))
            .select("product_id", F.concat(F.lit("M-"), C("l_partkey").cast("string")).alias("material_code"),
                    "required_quantity", F.lit("kg").alias("unit_of_measure")))


@query("recipe_expand", f"""
WITH lot AS (
{FEFO_SQL}),
bill AS (
  SELECT product_id, 'M-' || l_partkey AS material_code, CAST(min(l_quantity) AS DECIMAL(18,4)) AS need
  FROM lineitem SEMI JOIN materials ON material_code = 'M-' || l_partkey
       JOIN (SELECT o_custkey AS product_id, o_orderkey AS l_orderkey FROM orders) USING (l_orderkey)
  GROUP BY ALL),
share AS (SELECT unnest(['released', 'mixing']) AS status, unnest([0.9985, 1.0008]) AS factor),
todo AS (
  SELECT batch_id, material_id, material_code, need, status
  FROM bill JOIN (SELECT batch_id, product_id, status FROM batches) USING (product_id)
       JOIN (SELECT material_id, material_code FROM materials) USING (material_code)
  ANTI JOIN batch_materials USING (batch_id, material_id))
SELECT batch_id, material_id, internal_lot_number AS material_lot, CAST(need AS DOUBLE) AS required_quantity,
       CAST(round(need * factor, 4) AS DOUBLE) AS actual_quantity, 'kg' AS unit_of_measure,
       if(factor IS NULL, 'pending', 'verified') AS weighing_status, supply_material_id, material_lot_id AS supply_material_lot_id
FROM todo JOIN lot USING (material_code) LEFT JOIN share USING (status)
""")
def q_recipe_expand(r):
    """V17 recipe expansion per batch with FEFO lots, skipping existing lines."""
    return selection.recipe_expand(r.batches, recipe_of(r), r.materials, r.material_catalog, r.material_lots,
                                   r.batch_materials, RECIPE_FACTORS)


# ------------------------------------------------------------------ C1 / C2
_CAT_COLS = ("supply_material_id, material_code, material_name, material_type, unit_of_measure, "
             "preferred_supplier_id, CAST(reorder_point AS DOUBLE) AS reorder_point, "
             "CAST(reorder_quantity AS DOUBLE) AS reorder_quantity, active")


@query("upsert", f"""
SELECT t.supply_material_id, t.material_code,
       CASE WHEN s.supply_material_id IS NOT NULL THEN COALESCE(t.material_name, s.material_name)
            ELSE t.material_name END AS material_name,
       t.material_type, t.unit_of_measure,
       CASE WHEN s.supply_material_id IS NOT NULL THEN s.preferred_supplier_id ELSE t.preferred_supplier_id END
           AS preferred_supplier_id,
       CAST(CASE WHEN s.supply_material_id IS NOT NULL THEN s.reorder_point ELSE t.reorder_point END AS DOUBLE)
           AS reorder_point,
       CAST(CASE WHEN s.supply_material_id IS NOT NULL THEN s.reorder_quantity ELSE t.reorder_quantity END AS DOUBLE)
           AS reorder_quantity,
       CASE WHEN s.supply_material_id IS NOT NULL THEN s.active ELSE t.active END AS active
FROM material_catalog t LEFT JOIN catalog_updates s ON s.supply_material_id = t.supply_material_id
UNION ALL
SELECT {_CAT_COLS} FROM catalog_updates s
WHERE NOT EXISTS (SELECT 1 FROM material_catalog t WHERE t.supply_material_id = s.supply_material_id)
""")
def q_upsert(r):
    """C1 catalog upsert: listed columns overwritten, name kept first, new keys inserted."""
    return changes.upsert(r.material_catalog, r.catalog_updates, "supply_material_id",
                          update_cols=["preferred_supplier_id", "reorder_point", "reorder_quantity", "active"],
                          keep_first=["material_name"])


@query("insert_if_absent", f"""
SELECT {_CAT_COLS} FROM catalog_updates s
WHERE NOT EXISTS (SELECT 1 FROM material_catalog t WHERE t.supply_material_id = s.supply_material_id)
""")
def q_insert_if_absent(r):
    """C2 rows of the change batch whose key is new."""
    return changes.insert_if_absent(r.material_catalog, r.catalog_updates, "supply_material_id")


# ------------------------------------------------------------------ C3
@query("update_from", f"""
WITH pick AS (
{LATERAL_SQL}),
wanted AS (
  SELECT batch_material_id, pick.internal_lot_number AS lot, pick.material_lot_id AS lot_id
  FROM batch_materials SEMI JOIN (SELECT batch_id FROM batches WHERE status = 'mixing') USING (batch_id)
       JOIN (SELECT material_id, material_code FROM materials) USING (material_id) JOIN pick USING (material_code))
SELECT batch_material_id, batch_id, if(lot_id IS NULL, material_lot, lot) AS material_lot,
       if(lot_id IS NULL, supply_material_lot_id, lot_id) AS supply_material_lot_id,
       lot_id IS NOT NULL AND (lot, lot_id) IS DISTINCT FROM (material_lot, supply_material_lot_id) AS changed
FROM batch_materials LEFT JOIN wanted USING (batch_material_id)
""")
def q_update_from(r):
    """C3 genealogy patch: mixing batches take the lowest '-02' lot of each material."""
    top = selection.lateral_top1(r.material_catalog, r.material_lots)
    src = (r.batch_materials.select("batch_material_id", "batch_id", "material_id")
           .join(r.batches.where(C("status") == "mixing").select("batch_id"), "batch_id")
           .join(r.materials.select("material_id", "material_code"), "material_id")
           .join(top.select("material_code", "material_lot_id", "internal_lot_number"), "material_code")
           .select("batch_material_id", "material_lot_id", "internal_lot_number"))
    out = changes.update_from(r.batch_materials, src, "batch_material_id",
                              {"supply_material_lot_id": "material_lot_id", "material_lot": "internal_lot_number"})
    return out.select("batch_material_id", "batch_id", "material_lot", "supply_material_lot_id", "changed")


# ------------------------------------------------------------------ C4
EDITABLE = ["supplier_name", "status", "supplier_code"]


# The batch walked row by row: `there` is the number of rows a change finds, from the last insert or
# delete before it on the same supplier, else from the table.
_CHANGES_SQL = """
WITH ch AS (
  SELECT c.change_id, c.op, c.supplier_id, c."values" AS vals,
         list_sort(list_filter(map_keys(c."values"), lambda k: list_contains(['status', 'supplier_code', 'supplier_name'], k))) AS ks,
         (SELECT count(*) FROM suppliers s WHERE s.supplier_id = c.supplier_id) AS in_table
  FROM supplier_changes c),
checked AS (
  SELECT *, CASE WHEN supplier_id IS NULL THEN 'Complete primary key values are required.'
                 WHEN NOT coalesce(list_contains(['delete', 'insert', 'update'], op), false) THEN 'Unsupported operation.'
                 WHEN coalesce(len(ks), 0) = 0 AND op = 'update' THEN 'No editable column changes were supplied.'
                 WHEN coalesce(len(ks), 0) = 0 AND op = 'insert' THEN 'No insert values were supplied.' END AS broken
  FROM ch),
placed AS (
  SELECT *, CASE last_value(CASE WHEN broken IS NULL AND in_table < 2 AND op <> 'update' THEN op END IGNORE NULLS)
                   OVER (PARTITION BY supplier_id ORDER BY change_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                 WHEN 'insert' THEN 1 WHEN 'delete' THEN 0 ELSE in_table END AS there
  FROM checked),
judged AS (
  SELECT *, CASE WHEN broken IS NOT NULL THEN broken
                 WHEN op = 'insert' AND there > 0 THEN 'Row already exists.'
                 WHEN op <> 'insert' AND there <> 1 THEN 'Expected one row; affected ' || there || '.' END AS why
  FROM placed)
"""


@query("apply_changes", _CHANGES_SQL + """
SELECT change_id, op, supplier_id, CASE WHEN why IS NULL THEN 'applied' ELSE 'rejected' END AS status, why AS reason,
       coalesce(array_to_string(ks, ','), '') AS columns
FROM judged
""")
def q_apply_changes(r):
    """C4 table-editor batch against suppliers: audit of applied/rejected changes."""
    return changes.apply_changes(r.suppliers, r.supplier_changes, ["supplier_id"], EDITABLE)["audit"]


@query("apply_changes_state", _CHANGES_SQL + """,
turned AS (
  SELECT supplier_id, max(change_id) AS at, arg_max(op, change_id) AS op FROM judged
  WHERE why IS NULL AND op <> 'update' GROUP BY supplier_id),
cells AS (
  SELECT j.supplier_id, k.key, arg_max(struct_pack(v := j.vals[k.key]), j.change_id).v AS v
  FROM judged j LEFT JOIN turned t ON t.supplier_id = j.supplier_id, LATERAL (SELECT unnest(j.ks) AS key) k
  WHERE j.why IS NULL AND j.op <> 'delete' AND (t.at IS NULL OR j.change_id >= t.at) GROUP BY j.supplier_id, k.key),
cols AS (
  SELECT supplier_id, bool_or(key = 'supplier_name') AS has_name, bool_or(key = 'status') AS has_status,
         bool_or(key = 'supplier_code') AS has_code, max(v) FILTER (WHERE key = 'supplier_name') AS new_name,
         max(v) FILTER (WHERE key = 'status') AS new_status, max(v) FILTER (WHERE key = 'supplier_code') AS new_code
  FROM cells GROUP BY supplier_id)
SELECT s.supplier_id, CASE WHEN c.has_code THEN c.new_code ELSE s.supplier_code END AS supplier_code,
       CASE WHEN c.has_name THEN c.new_name ELSE s.supplier_name END AS supplier_name,
       CASE WHEN c.has_status THEN c.new_status ELSE s.status END AS status
FROM suppliers s LEFT JOIN cols c ON c.supplier_id = s.supplier_id
WHERE s.supplier_id NOT IN (SELECT supplier_id FROM turned)
UNION ALL
SELECT t.supplier_id, c.new_code, c.new_name, c.new_status FROM turned t JOIN cols c ON c.supplier_id = t.supplier_id
WHERE t.op = 'insert'
""")
def q_apply_changes_state(r):
    """C4 supplier table after the batch."""
    state = changes.apply_changes(r.suppliers, r.supplier_changes, ["supplier_id"], EDITABLE)["state"]
    return state.select("supplier_id", "supplier_code", "supplier_name", "status")


# ------------------------------------------------------------------ C6
REVIEWED_AT = "2024-02-01 00:00:00"


@query("review_transitions", f"""
WITH d AS (SELECT dd.request_id, dd.status, dd.admin_note, dd.reviewed_by, rq.status AS cur
           FROM reset_decisions dd LEFT JOIN reset_requests rq ON rq.request_id = dd.request_id),
rs AS (SELECT d.*, CASE WHEN status NOT IN ('Requested', 'Pending Admin Reconciliation', 'Approved', 'Completed',
                                             'Rejected') THEN 'bad'
                        WHEN cur IS NULL THEN 'missing'
                        WHEN status = 'Completed' AND cur <> 'Approved' THEN 'order'
                        WHEN cur IN ('Completed', 'Rejected') AND status <> cur THEN 'terminal' END AS why
       FROM d),
acc AS (SELECT request_id, status AS new_status, admin_note AS note, reviewed_by AS who FROM rs WHERE why IS NULL)
SELECT q.request_id, q.session_id, q.reset_scope, q.operator, q.reason, COALESCE(a.new_status, q.status) AS status,
       q.requested_at,
       CASE WHEN a.new_status IN ('Completed', 'Rejected') THEN TIMESTAMP '{REVIEWED_AT}' ELSE q.completed_at END
           AS completed_at,
       CASE WHEN a.request_id IS NOT NULL THEN a.note ELSE q.admin_note END AS admin_note,
       CASE WHEN a.request_id IS NOT NULL THEN a.who ELSE q.reviewed_by END AS reviewed_by,
       CASE WHEN a.request_id IS NOT NULL THEN TIMESTAMP '{REVIEWED_AT}' ELSE q.reviewed_at END AS reviewed_at
FROM reset_requests q LEFT JOIN acc a ON a.request_id = q.request_id
""")
def q_review_transitions(r):
    """C6 review decisions applied to reset requests (new request state)."""
    now = F.lit(REVIEWED_AT).cast("timestamp_ntz")
    return changes.review_transitions(r.reset_requests, r.reset_decisions, reviewed_at=now)["state"]


# ------------------------------------------------------------------ C7
@query("check_constraints", """
SELECT 'target_quantity_not_null' AS constraint_name, CAST(weighing_transaction_id AS VARCHAR) AS row_key,
       CAST(NULL AS VARCHAR) AS detail FROM weighing_transactions WHERE target_quantity IS NULL
UNION ALL
SELECT 'status_check', weighing_transaction_id, status FROM weighing_transactions
WHERE NOT status IN ('pending', 'ready', 'weighed', 'verified', 'rejected')
UNION ALL
SELECT 'actual_quantity_non_negative', weighing_transaction_id, CAST(CAST(actual_quantity AS DECIMAL(18,4)) AS VARCHAR)
FROM weighing_transactions WHERE actual_quantity < 0
UNION ALL
SELECT 'tare_confirmed_required', weighing_transaction_id, NULL FROM weighing_transactions
WHERE NOT (status IN ('pending', 'ready') OR tare_confirmed)
UNION ALL
SELECT 'reservation_id_unique', w.weighing_transaction_id, w.reservation_id FROM weighing_transactions w
WHERE w.reservation_id IN (SELECT reservation_id FROM weighing_transactions WHERE reservation_id IS NOT NULL
                           GROUP BY reservation_id HAVING COUNT(*) > 1)
UNION ALL
SELECT 'material_lot_id_fkey', w.weighing_transaction_id, w.material_lot_id FROM weighing_transactions w
WHERE w.material_lot_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM material_lots ml WHERE ml.material_lot_id = w.material_lot_id)
""")
def q_check_constraints(r):
    """C7 constraint violations of weighing transactions (incl. the tare rule)."""
    w = r.weighing_transactions
    return changes.check_constraints(
        w, "weighing_transaction_id", not_null=["target_quantity"],
        enums={"status": ["pending", "ready", "weighed", "verified", "rejected"]},
        non_negative=["actual_quantity"], unique=[["reservation_id"]],
        foreign={"material_lot_id": (r.material_lots, "material_lot_id")},
        rules={"tare_confirmed_required": C("status").isin("pending", "ready") | C("tare_confirmed")})


# ------------------------------------------------------------------ C9
@query("json_merge", """
SELECT event_id,
       '{"k":' || CAST(CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) + 1
                            ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS VARCHAR)
       || ',"seen":true}' AS merged
FROM events
""")
def q_json_merge(r):
    """C9 shallow JSON merge of event props with a per-type patch (right side wins)."""
    e = r.table("events")
    k = F.get_json_object("props", "$.k").cast("int")
    patch = F.when(C("event_type") == "click", F.concat(F.lit('{"seen":true,"k":'), (k + 1).cast("string"), F.lit("}"))) \
             .otherwise(F.lit('{"seen":true}'))
    return e.select("event_id", changes.json_merge(C("props"), patch).alias("merged"))


# ------------------------------------------------------------------ C11
@query("replace_children", """
WITH fresh AS (
  SELECT concat('R-', process_run_id) AS process_parameter_id, process_run_id, 'retest_weight' AS parameter_name,
         'CPP' AS parameter_type, CAST(25 AS DECIMAL(18,6)) AS target_value,
         CAST(actual_duration_seconds / 60 AS DECIMAL(18,6)) AS actual_value, CAST(5 AS DECIMAL(18,6)) AS lower_limit,
         CAST(45 AS DECIMAL(18,6)) AS upper_limit, 'g' AS unit_of_measure,
         actual_duration_seconds BETWEEN 300 AND 2700 AS within_spec, started_at AS recorded_at
  FROM process_runs WHERE status = 'failed'),
st AS (SELECT * FROM process_parameters pp
       WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.process_run_id = pp.process_run_id)
       UNION ALL SELECT * FROM fresh)
SELECT process_parameter_id, process_run_id, parameter_name, CAST(actual_value AS DOUBLE) AS actual_value, within_spec
FROM st
""")
def q_replace_children(r):
    """C11 rebuild the parameters of failed runs: old children dropped, new set inserted."""
    runs = r.process_runs.where(C("status") == "failed")
    fresh = runs.select(
        F.concat(F.lit("R-"), C("process_run_id")).alias("process_parameter_id"), "process_run_id",
        F.lit("retest_weight").alias("parameter_name"), F.lit("CPP").alias("parameter_type"),
        F.lit(25).cast("decimal(18,6)").alias("target_value"),
        (C("actual_duration_seconds") / 60).cast("decimal(18,6)").alias("actual_value"),
        F.lit(5).cast("decimal(18,6)").alias("lower_limit"), F.lit(45).cast("decimal(18,6)").alias("upper_limit"),
        F.lit("g").alias("unit_of_measure"),
        C("actual_duration_seconds").between(300, 2700).alias("within_spec"), C("started_at").alias("recorded_at"))
    st = changes.replace_children(r.process_parameters, fresh, "process_run_id")
    return st.select("process_parameter_id", "process_run_id", "parameter_name", "actual_value", "within_spec")
