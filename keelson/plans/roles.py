"""Role binding: the driver's tables projected into the reference's data model.

The operators in ``keelson.operators`` take DataFrames with the reference's
column names and know nothing about the driver tables.  This module derives
each input by projection (and a row filter at most) from one driver table, so
every derived input grows with the data and Catalyst prunes the scan to the
columns an operator actually reads.

Each role is written once as SQL expressions.  Spark applies them with
``where`` + ``selectExpr``; the DuckDB oracle gets the same text as CTEs.
Where the two dialects differ, an expression is a ``(spark, duckdb)`` pair.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Unique line id: (l_orderkey, l_linenumber) repeats in the driver data.
LINE_ID = ("concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), "
           "cast(l_partkey as string), cast(l_suppkey as string), "
           "cast(cast(l_shipdate as date) as string))")


def _hours_after(ts: str, hours: str):
    # A literal base is written TIMESTAMP '...'; Spark gets the wall-clock (NTZ) form.
    spark_ts = ts.replace("timestamp '", "timestamp_ntz '")
    return (f"{spark_ts} + make_interval(0, 0, 0, 0, cast({hours} as int), 0, 0)",
            f"{ts} + to_hours(cast({hours} as bigint))")


def _days_after(ts: str, days: str):
    return (f"date_add(cast({ts} as date), cast({days} as int))",
            f"cast(cast({ts} as date) + cast({days} as integer) as date)")


Q4 = "cast(l_quantity as decimal(18,4))"


@dataclass
class Role:
    name: str
    source: str
    columns: list  # (name, expr) with expr str or (spark, duckdb)
    where: str | None = None
    distinct: bool = False
    prelude: list = field(default_factory=list)  # helper columns computed once, before ``columns``
    doc: str = field(default="")

    def spark_exprs(self):
        return [f"{e if isinstance(e, str) else e[0]} AS {n}" for n, e in self.columns]

    def sql_exprs(self):
        return [f"{e if isinstance(e, str) else e[1]} AS {n}" for n, e in self.columns]


ROLES: dict[str, Role] = {}


def _role(name, source, columns, where=None, distinct=False, prelude=()):
    ROLES[name] = Role(name, source, columns, where, distinct, list(prelude))


# ---------------------------------------------------------------- process model
_role("products", "part", [
    ("product_id", "p_partkey"),
    ("product_code", "concat('P-', cast(p_partkey as string))"),
    ("product_name", "p_name"),
    ("dosage_form", "p_type"),
    ("strength", "cast(p_size as string)"),
    ("unit_of_measure", "'EA'"),
    ("active", "true"),
])
_role("production_orders", "customer", [
    ("production_order_id", "c_custkey"),
    ("po_number", "concat('PO-', cast(c_custkey as string))"),
    ("product_id", "c_custkey"),
    ("planned_quantity", "cast(abs(c_acctbal) as decimal(18,4))"),
    ("status", "lower(c_mktsegment)"),
])
_role("batches", "orders", [
    ("batch_id", "o_orderkey"),
    ("batch_number", "concat('B-', cast(o_orderkey as string))"),
    ("production_order_id", "o_custkey"),
    ("product_id", "o_custkey"),
    ("target_quantity", "cast(o_totalprice as decimal(18,4))"),
    ("actual_quantity", "cast(cast(o_totalprice as decimal(18,4)) * (CASE o_orderpriority "
                        "WHEN '1-URGENT' THEN 0.99 WHEN '2-HIGH' THEN 0.97 WHEN '3-MEDIUM' THEN 0.95 "
                        "WHEN '4-NOT SPECIFIED' THEN 0.90 END) as decimal(18,4))"),
    ("unit_of_measure", "'kg'"),
    ("status", "CASE o_orderstatus WHEN 'F' THEN 'released' WHEN 'O' THEN 'mixing' ELSE 'packaging' END"),
    ("started_at", "o_orderdate"),
    ("completed_at", tuple(f"CASE WHEN o_orderstatus = 'P' THEN NULL ELSE {x} END"
                           for x in _hours_after("o_orderdate", "o_orderkey % 10"))),
    ("released_at", tuple(f"CASE WHEN o_orderstatus = 'F' THEN {x} ELSE NULL END"
                          for x in _hours_after("o_orderdate", "o_orderkey % 10 + 24"))),
])
_role("process_steps", "part", [
    ("process_step_id", "p_partkey"),
    ("product_id", "p_partkey"),
    ("step_code", "concat('S-', cast(p_partkey as string))"),
    ("step_name", "p_name"),
    ("sequence_number", "p_size"),
    ("step_type", "p_type"),
    ("target_duration_seconds", "p_size * 60"),
])
_role("equipment", "supplier", [
    ("equipment_id", "s_suppkey"),
    ("equipment_code", "concat('EQ-', cast(s_suppkey as string))"),
    ("equipment_name", "s_name"),
    ("equipment_type", "'line'"),
    ("area", "cast(s_nationkey as string)"),
    ("status", "CASE WHEN s_acctbal < 0 THEN 'maintenance' ELSE 'available' END"),
    ("last_calibration_at", ("cast(NULL as timestamp_ntz)", "cast(NULL as timestamp)")),
    ("next_calibration_due", ("cast(NULL as timestamp_ntz)", "cast(NULL as timestamp)")),
])
_role("process_runs", "lineitem", [
    ("process_run_id", LINE_ID),
    ("batch_id", "l_orderkey"),
    ("process_step_id", "l_partkey"),
    ("equipment_id", "l_suppkey"),
    ("run_number", "l_linenumber"),
    ("status", "CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN l_returnflag = 'R' THEN 'failed' "
               "ELSE 'running' END"),
    ("started_at", "l_shipdate"),
    ("completed_at", tuple(f"CASE WHEN l_linestatus = 'F' THEN {x} ELSE NULL END"
                           for x in _hours_after("l_shipdate", "l_quantity"))),
    ("actual_duration_seconds", "cast(l_quantity as int) * 60"),
    ("operator_name", "concat('op-', cast(l_suppkey as string))"),
])
_role("deviations", "lineitem", [
    ("deviation_id", LINE_ID),
    ("deviation_number", f"concat('DEV-', {LINE_ID})"),
    ("batch_id", "l_orderkey"),
    ("process_run_id", LINE_ID),
    ("equipment_id", "l_suppkey"),
    ("severity", "CASE WHEN l_discount >= 0.07 THEN 'critical' WHEN l_discount >= 0.04 THEN 'major' "
                 "ELSE 'minor' END"),
    ("category", "'process'"),
    ("description", "concat('returned line ', cast(l_linenumber as string))"),
    ("status", "CASE WHEN l_linestatus = 'O' THEN (CASE WHEN l_tax >= 0.04 THEN 'investigating' ELSE 'open' END) "
               "ELSE (CASE WHEN l_tax >= 0.07 THEN 'cancelled' ELSE 'closed' END) END"),
    ("opened_at", "l_shipdate"),
    ("closed_at", tuple(f"CASE WHEN l_linestatus = 'F' THEN {x} ELSE NULL END"
                        for x in _hours_after("l_shipdate", "l_quantity"))),
    ("root_cause", "CASE WHEN l_linestatus = 'F' THEN 'handling' ELSE NULL END"),
    ("corrective_action", "CASE WHEN l_linestatus = 'F' THEN 'retrain' ELSE NULL END"),
], where="l_returnflag = 'R'")
_role("quality_results", "lineitem", [
    ("quality_result_id", LINE_ID),
    ("batch_id", "l_orderkey"),
    ("test_name", "concat('assay-', cast(l_linenumber as string))"),
    ("test_method", "'HPLC'"),
    ("sample_id", f"concat('S-', {LINE_ID})"),
    ("result_numeric", "cast(l_discount as decimal(18,6))"),
    ("result_text", "cast(NULL as string)"),
    ("lower_spec_limit", "cast(0 as decimal(18,6))"),
    ("upper_spec_limit", "cast(0.05 as decimal(18,6))"),
    ("unit_of_measure", "'%'"),
    ("disposition", "CASE WHEN l_discount <= 0.05 THEN 'pass' WHEN l_discount <= 0.08 THEN 'fail' "
                    "ELSE 'pending' END"),
    ("tested_at", "l_shipdate"),
    ("analyst_name", "concat('qa-', cast(l_suppkey as string))"),
], where="l_returnflag <> 'R'")
_role("process_parameters", "lineitem", [
    ("process_parameter_id", LINE_ID),
    ("process_run_id", LINE_ID),
    ("parameter_name", "'fill_weight'"),
    ("parameter_type", "'CPP'"),
    ("target_value", "cast(25 as decimal(18,6))"),
    ("actual_value", "cast(l_quantity as decimal(18,6))"),
    ("lower_limit", "cast(5 as decimal(18,6))"),
    ("upper_limit", "cast(45 as decimal(18,6))"),
    ("unit_of_measure", "'g'"),
    ("within_spec", "CASE WHEN l_tax = 0 THEN NULL ELSE (l_quantity BETWEEN 5 AND 45) END"),
    ("recorded_at", "l_shipdate"),
])
_role("packaging_records", "lineitem", [
    ("packaging_record_id", LINE_ID),
    ("batch_id", "l_orderkey"),
    ("equipment_id", "l_suppkey"),
    ("packaging_line", "concat('PL-', cast(l_suppkey as string))"),
    ("package_type", "'bottle'"),
    ("target_units", "cast(l_quantity as bigint)"),
    ("produced_units", "CASE WHEN l_tax = 0.08 THEN NULL ELSE cast(l_quantity as bigint) - "
                       "cast(floor(l_quantity * round(l_discount * 100) / 100) as bigint) END"),
    ("rejected_units", "cast(floor(l_quantity * round(l_discount * 100) / 100) as bigint)"),
    ("status", "'completed'"),
    ("started_at", "l_shipdate"),
    ("completed_at", "l_shipdate"),
])
_role("materials", "part", [
    ("material_id", "p_partkey"),
    ("material_code", "concat('M-', cast(p_partkey as string))"),
    ("material_name", "p_name"),
    ("material_type", "CASE WHEN p_size <= 10 THEN 'api' WHEN p_size <= 30 THEN 'excipient' ELSE 'packaging' END"),
    ("unit_of_measure", "'kg'"),
    ("lot_controlled", "true"),
])
_role("batch_materials", "lineitem", [
    ("batch_material_id", LINE_ID),
    ("batch_id", "l_orderkey"),
    ("material_id", "l_partkey"),
    ("material_lot", LINE_ID),
    ("required_quantity", Q4),
    ("actual_quantity", f"CASE WHEN l_linestatus = 'O' THEN NULL ELSE {Q4} END"),
    ("unit_of_measure", "'kg'"),
    ("weighing_status", "CASE WHEN l_linestatus = 'F' THEN 'verified' WHEN l_returnflag = 'A' THEN 'weighed' "
                        "ELSE 'pending' END"),
    ("weighed_at", "CASE WHEN l_linestatus = 'F' OR l_returnflag = 'A' THEN l_shipdate ELSE NULL END"),
    ("verified_by", "CASE WHEN l_linestatus = 'F' THEN 'qa' ELSE NULL END"),
    ("supply_material_id", "l_partkey"),
    ("supply_material_lot_id", LINE_ID),
    ("supply_reservation_id", LINE_ID),
    ("supply_material_issue_id", f"CASE WHEN l_linestatus = 'F' THEN {LINE_ID} ELSE NULL END"),
])

# ------------------------------------------------------------------ supply model
_role("suppliers", "supplier", [
    ("supplier_id", "s_suppkey"),
    ("supplier_code", "concat('SUP-', cast(s_suppkey as string))"),
    ("supplier_name", "s_name"),
    ("status", "CASE WHEN s_acctbal < 0 THEN 'on-hold' ELSE 'approved' END"),
])
_role("material_catalog", "part", [
    ("supply_material_id", "p_partkey"),
    ("material_code", "concat('M-', cast(p_partkey as string))"),
    ("material_name", "p_name"),
    ("material_type", "CASE WHEN p_size <= 10 THEN 'api' WHEN p_size <= 30 THEN 'excipient' ELSE 'packaging' END"),
    ("unit_of_measure", "'kg'"),
    ("preferred_supplier_id", "p_partkey % 10"),
    ("reorder_point", "cast(p_size * 10 as decimal(18,4))"),
    ("reorder_quantity", "cast(p_size * 20 as decimal(18,4))"),
    ("active", "true"),
])
_role("material_lots", "lineitem", [
    ("material_lot_id", LINE_ID),
    ("supply_material_id", "l_partkey"),
    ("supplier_id", "l_suppkey"),
    ("internal_lot_number", LINE_ID),
    ("received_quantity", Q4),
    ("available_quantity", f"CASE WHEN l_linestatus = 'F' THEN cast(0 as decimal(18,4)) ELSE {Q4} END"),
    ("reserved_quantity", f"CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN {Q4} "
                          "ELSE cast(0 as decimal(18,4)) END"),
    ("status", "CASE l_returnflag WHEN 'A' THEN 'released' WHEN 'N' THEN 'available' ELSE 'blocked' END"),
    ("received_at", "l_shipdate"),
    ("expiry_date", _days_after("l_shipdate", "l_quantity * 30")),
    ("location_id", "l_suppkey"),
])
_role("material_requests", "orders", [
    ("material_request_id", "o_orderkey"),
    ("request_number", "concat('MR-', cast(o_orderkey as string))"),
    ("pharma_production_order_id", "o_custkey"),
    ("pharma_batch_id", "o_orderkey"),
    ("status", "CASE o_orderstatus WHEN 'F' THEN 'issued' WHEN 'O' THEN 'reserved' ELSE 'submitted' END"),
    ("requested_at", "o_orderdate"),
    ("fulfilled_at", tuple(f"CASE WHEN o_orderstatus = 'F' THEN {x} ELSE NULL END"
                           for x in _hours_after("o_orderdate", "2"))),
    ("correlation_id", "concat('corr-', cast(o_orderkey as string))"),
])
_role("material_request_lines", "lineitem", [
    ("material_request_line_id", LINE_ID),
    ("material_request_id", "l_orderkey"),
    ("supply_material_id", "l_partkey"),
    ("pharma_batch_material_id", LINE_ID),
    ("requested_quantity", Q4),
    ("reserved_quantity", f"CASE WHEN l_linestatus = 'O' THEN {Q4} ELSE cast(0 as decimal(18,4)) END"),
    ("issued_quantity", f"CASE WHEN l_linestatus = 'F' THEN {Q4} ELSE cast(0 as decimal(18,4)) END"),
    ("unit_of_measure", "'kg'"),
    ("status", "CASE WHEN l_linestatus = 'F' THEN 'issued' ELSE 'reserved' END"),
])
_role("material_reservations", "lineitem", [
    ("reservation_id", LINE_ID),
    ("material_request_line_id", LINE_ID),
    ("material_lot_id", LINE_ID),
    ("reserved_quantity", Q4),
    ("status", "CASE WHEN l_linestatus = 'F' THEN 'issued' WHEN l_returnflag = 'R' THEN 'cancelled' "
               "ELSE 'reserved' END"),
    ("reserved_at", "l_shipdate"),
    ("released_at", ("cast(NULL as timestamp_ntz)", "cast(NULL as timestamp)")),
])
_role("weighing_transactions", "lineitem", [
    ("weighing_transaction_id", LINE_ID),
    ("reservation_id", LINE_ID),
    ("material_lot_id", LINE_ID),
    ("pharma_batch_material_id", LINE_ID),
    ("target_quantity", Q4),
    ("actual_quantity", f"CASE WHEN l_linestatus = 'F' THEN {Q4} ELSE NULL END"),
    ("tare_confirmed", "l_linestatus = 'F' OR l_tax > 0.06"),
    ("status", "CASE WHEN l_linestatus = 'F' THEN 'verified' WHEN l_tax > 0.05 THEN 'weighed' ELSE 'ready' END"),
], where="l_linestatus = 'F' OR l_returnflag = 'A'")
_role("material_issues", "lineitem", [
    ("material_issue_id", LINE_ID),
    ("material_request_id", "l_orderkey"),
    ("material_request_line_id", LINE_ID),
    ("reservation_id", LINE_ID),
    ("material_lot_id", LINE_ID),
    ("pharma_batch_id", "l_orderkey"),
    ("pharma_batch_material_id", LINE_ID),
    ("issued_quantity", Q4),
    ("issued_at", "l_shipdate"),
    ("correlation_id", "concat('corr-', cast(l_orderkey as string))"),
], where="l_linestatus = 'F'")


# -------------------------------------------------------------------- loading
class Roles:
    """Lazy access to role DataFrames over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        key = "table:" + name
        if key not in self._cache:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            self._cache[key] = df
        return self._cache[key]

    def stream(self, name: str) -> DataFrame:
        """A driver table or role as a streaming DataFrame (file source over the table's file).

        The path is a one-file glob (``x.parque[t]``) because the file stream
        source lists a directory or a glob; the role's filter and projection
        apply to the stream unchanged.
        """
        table = name if name in DRIVER_TABLES else ROLES[name].source
        path = f"{self.sf_dir}/{table}.parque[t]"
        df = self.spark.readStream.schema(self.table(table).schema).parquet(path)
        if name in DRIVER_TABLES:
            return df
        role = ROLES[name]
        if role.where:
            df = df.where(role.where)
        if role.prelude:
            df = df.selectExpr("*", *[f"{e if isinstance(e, str) else e[0]} AS {n}" for n, e in role.prelude])
        return df.selectExpr(*role.spark_exprs())

    def __getitem__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.table(name)
        if name not in self._cache:
            role = ROLES[name]
            df = self.table(role.source)
            if role.where:
                df = df.where(role.where)
            if role.prelude:
                df = df.selectExpr("*", *[f"{e if isinstance(e, str) else e[0]} AS {n}" for n, e in role.prelude])
            df = df.selectExpr(*role.spark_exprs())
            self._cache[name] = df.distinct() if role.distinct else df
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        # Only called for names that are not real attributes: roles and tables.
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]


def role_ctes(*names: str) -> str:
    """``WITH`` clause defining the named roles for the DuckDB oracle."""
    parts = []
    for n in names:
        r = ROLES[n]
        where = f" WHERE {r.where}" if r.where else ""
        dist = "DISTINCT " if r.distinct else ""
        src = r.source
        if r.prelude:
            pre = ", ".join(f"{e if isinstance(e, str) else e[1]} AS {pn}" for pn, e in r.prelude)
            src = f"(SELECT *, {pre} FROM {r.source}) {r.source}"
        parts.append(f"{n} AS (SELECT {dist}{', '.join(r.sql_exprs())} FROM {src}{where})")
    return "WITH " + ",\n".join(parts) + "\n"


def with_roles(body: str) -> str:
    """Prefix ``body`` with CTEs for every role it names (word match)."""
    import re
    used = [n for n in ROLES if re.search(rf"\b{n}\b", body)]
    if not used:
        return body
    head = role_ctes(*used)
    stripped = body.lstrip()
    if stripped[:4].upper() == "WITH":
        return head.rstrip() + ",\n" + stripped[4:].lstrip()
    return head + body


# ------------------------------------------------------------- telemetry / power
# Readings are the events table: one electrical reading per event, the user is
# the asset.  ``k`` is the integer in the props JSON.
_K = ("cast(get_json_object(props, '$.k') as int)", "cast(json_extract_string(props, '$.k') as integer)")
_role("assets", "customer", [
    ("asset_id", "c_custkey"),
    ("asset_name", "c_name"),
    ("phases", "CASE WHEN c_nationkey % 2 = 0 THEN 3 ELSE 1 END"),
    ("voltage_v", "cast(CASE WHEN c_nationkey % 2 = 0 THEN 480 ELSE 240 END as double)"),
    ("rated_current_a", "cast(20 + c_nationkey * 4 as double)"),
])
_role("telemetry_readings", "events", prelude=[("k", _K)], columns=[
    ("reading_id", "event_id"),
    ("asset_id", "user_id"),
    ("recorded_at", "ts"),
    ("real_power_kw", "value"),
    ("power_factor", tuple(f"cast(greatest(68, least(99, 70 + {k} % 30)) as double) / 100" for k in ("k", "k"))),
    ("equipment_temperature_c", tuple(f"cast(2800 + {k} * 31 + CASE WHEN event_type = 'error' THEN 2500 ELSE 0 END"
                                      f" as double) / 100" for k in ("k", "k"))),
    ("health_pct", tuple(f"cast(CASE WHEN event_type = 'error' THEN 392 - {k} ELSE 392 END as double) / 4"
                         for k in ("k", "k"))),
    ("fault_code", tuple(f"CASE WHEN event_type = 'error' AND {k} >= 80 THEN 'OVERCURRENT_TRIP' "
                         f"WHEN event_type = 'error' AND {k} < 15 THEN 'BEARING_WEAR' END" for k in ("k", "k"))),
])


# --------------------------------------------------------------- change sets
# Deterministic change batches derived from the driver tables.
_NEW_ID = "CASE WHEN p_size = 1 THEN -p_partkey - 1 ELSE p_partkey END"
_role("catalog_updates", "part", [
    ("supply_material_id", _NEW_ID),
    ("material_code", f"concat('M-', cast({_NEW_ID} as string))"),
    ("material_name", "concat('NEW ', p_name)"),
    ("material_type", "'excipient'"),
    ("unit_of_measure", "'kg'"),
    ("preferred_supplier_id", "(p_partkey + 1) % 10"),
    ("reorder_point", "cast(p_size * 15 as decimal(18,4))"),
    ("reorder_quantity", "cast(p_size * 25 as decimal(18,4))"),
    ("active", "p_size <> 14"),
], where="p_size % 7 = 0 OR p_size = 1")

# Admin control plane: one reset request per conversation, decisions from turn 1.
_REQ_STATUS = ("CASE conv_id % 5 WHEN 0 THEN 'Requested' WHEN 1 THEN 'Pending Admin Reconciliation' "
               "WHEN 2 THEN 'Approved' WHEN 3 THEN 'Completed' ELSE 'Rejected' END")
_role("reset_requests", "conversations", [
    ("request_id", "conv_id"),
    ("session_id", "conv_id"),
    ("reset_scope", "'session'"),
    ("operator", "concat('operator-', cast(conv_id % 3 as string))"),
    ("reason", "'demo reset'"),
    ("status", _REQ_STATUS),
    ("requested_at", _hours_after("timestamp '2024-01-01 00:00:00'", "conv_id")),
    ("completed_at", tuple(f"CASE WHEN conv_id % 5 >= 3 THEN {x} END"
                           for x in _hours_after("timestamp '2024-01-01 00:00:00'", "conv_id + 1"))),
    ("admin_note", "cast(NULL as string)"),
    ("reviewed_by", "cast(NULL as string)"),
    ("reviewed_at", ("cast(NULL as timestamp_ntz)", "cast(NULL as timestamp)")),
], where="turn = 0")
_role("reset_decisions", "conversations", [
    ("request_id", "conv_id"),
    ("status", "CASE length(text) % 6 WHEN 0 THEN 'Requested' WHEN 1 THEN 'Pending Admin Reconciliation' "
               "WHEN 2 THEN 'Approved' WHEN 3 THEN 'Completed' WHEN 4 THEN 'Rejected' ELSE 'Archived' END"),
    ("admin_note", "concat('turn ', cast(turn as string))"),
    ("reviewed_by", "'admin'"),
], where="turn = 1")
_role("reset_decision_log", "conversations", [
    ("request_id", "conv_id"),
    ("turn", "turn"),
    ("status", "CASE length(text) % 6 WHEN 0 THEN 'Requested' WHEN 1 THEN 'Pending Admin Reconciliation' "
               "WHEN 2 THEN 'Approved' WHEN 3 THEN 'Completed' WHEN 4 THEN 'Rejected' ELSE 'Archived' END"),
    ("admin_note", "concat('turn ', cast(turn as string))"),
    ("reviewed_by", "'admin'"),
], where="turn BETWEEN 1 AND 3")
_role("demo_sessions", "conversations", [
    ("session_id", "conv_id"),
    ("status", "'Active'"),
    ("created_at", _hours_after("timestamp '2024-01-01 00:00:00'", "conv_id")),
    ("last_seen_at", _hours_after("timestamp '2024-01-01 00:00:00'", "conv_id + 2")),
], where="turn = 0")
_role("demo_session_entities", "conversations", [
    ("session_id", "conv_id"),
    ("entity_type", "role"),
    ("entity_id", "cast(turn as string)"),
    ("active", "role <> 'system'"),
])
# Table-editor change batch against suppliers: one change per customer.
_role("supplier_changes", "customer", [
    ("change_id", "c_custkey"),
    ("op", "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'update' WHEN 'BUILDING' THEN 'delete' "
           "WHEN 'FURNITURE' THEN 'insert' WHEN 'MACHINERY' THEN 'update' ELSE 'upsert' END"),
    ("supplier_id", "CASE WHEN c_mktsegment = 'FURNITURE' THEN 100000 + c_custkey "
                    "WHEN c_mktsegment = 'HOUSEHOLD' AND c_custkey % 2 = 0 THEN NULL ELSE cast(c_nationkey as bigint) END"),
    ("values", ("CASE WHEN c_mktsegment = 'MACHINERY' THEN map('supplier_id', '7', 'created_at', 'x') "
                "ELSE map('supplier_name', c_name, 'status', lower(c_mktsegment), 'supplier_code', "
                "concat('SUP-', cast(c_custkey as string))) END",
                "CASE WHEN c_mktsegment = 'MACHINERY' THEN MAP {'supplier_id': '7', 'created_at': 'x'} "
                "ELSE MAP {'supplier_name': c_name, 'status': lower(c_mktsegment), 'supplier_code': "
                "concat('SUP-', cast(c_custkey as string))} END")),
])


# ------------------------------------------------------------ baseline / live
# Live lots = the lot table with deterministic drift against its baseline:
# partkey % 7 = 0 gains one unit, = 1 is marked depleted, and first lines of
# partkey % 7 = 2 are missing from live.
_role("live_lots", "lineitem", [
    ("internal_lot_number", LINE_ID),
    ("material_code", "concat('M-', cast(l_partkey as string))"),
    ("available_quantity", f"CASE WHEN l_partkey % 7 = 0 THEN (CASE WHEN l_linestatus = 'F' THEN "
                           f"cast(0 as decimal(18,4)) ELSE {Q4} END) + 1 WHEN l_linestatus = 'F' THEN "
                           f"cast(0 as decimal(18,4)) ELSE {Q4} END"),
    ("reserved_quantity", f"CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN {Q4} "
                          "ELSE cast(0 as decimal(18,4)) END"),
    ("status", "CASE WHEN l_partkey % 7 = 1 THEN 'depleted' WHEN l_returnflag = 'A' THEN 'released' "
               "WHEN l_returnflag = 'N' THEN 'available' ELSE 'blocked' END"),
], where="NOT (l_partkey % 7 = 2 AND l_linenumber = 1)")

# Restore: live tables and the baselines of two snapshots; lot and tank keys repeat in the baselines, statuses come in mixed case.
ORDER_LINE = "concat(cast(l_orderkey as string), '-', cast(l_linenumber as string))"
_MIXED_CASE = "CASE l_partkey % 4 WHEN 0 THEN 'Released' WHEN 1 THEN 'released' WHEN 2 THEN 'AVAILABLE' ELSE 'on hold' END"
_SNAPSHOT = "CASE WHEN l_suppkey % 3 = 0 THEN 'evening' ELSE 'morning' END"
_role("twin_lots", "lineitem", [
    ("internal_lot_number", ORDER_LINE),
    ("material_code", "concat('M-', cast(l_partkey as string))"),
    ("available_quantity", f"{Q4} + 1"),
    ("reserved_quantity", Q4),
    ("status", "'blocked'"),
], where="l_linenumber <> 5")
_role("twin_inventory", "lineitem", [
    ("lot_number", ORDER_LINE),
    ("quantity", "cast(0 as decimal(18,4))"),
    ("reserved_quantity", "cast(0 as decimal(18,4))"),
    ("qa_status", "'Unknown'"),
], where="l_linenumber <= 3")
_role("lot_baseline", "lineitem", [
    ("snapshot_id", _SNAPSHOT),
    ("internal_lot_number", ORDER_LINE),
    ("available_quantity", Q4),
    ("reserved_quantity", "cast(l_linenumber as decimal(18,4))"),
    ("status", _MIXED_CASE),
], where="l_linenumber <> 6")
_role("twin_positions", "lineitem", [
    ("container_id", LINE_ID),
    ("material_code", "concat('M-', cast(l_partkey as string))"),
    ("lot_number", ORDER_LINE),
    ("quantity", Q4),
    ("location_code", "CASE l_suppkey % 4 WHEN 0 THEN 'CW-STAGE-01' WHEN 1 THEN 'CW-HAZ-01' WHEN 2 THEN 'DOCK-02' END"),
    ("status", "'Moved'"),
    ("hazard_class", "CASE WHEN l_suppkey % 4 = 1 THEN 'flammable' END"),
    ("campaign_id", "concat('C-', cast(l_orderkey as string))"),
    ("po_number", "concat('PO-', cast(l_orderkey as string))"),
], where="l_linenumber = 1")
_role("staging_baseline", "lineitem", [
    ("snapshot_id", _SNAPSHOT),
    ("container_id", LINE_ID),
    ("material_code", "concat('M-', cast(l_partkey as string))"),
    ("lot_number", ORDER_LINE),
    ("quantity", Q4),
    ("location_code", "CASE l_suppkey % 2 WHEN 0 THEN 'CW-STAGE-01' ELSE 'CW-HAZ-01' END"),
    ("hazard_class", "CASE WHEN l_suppkey % 2 = 1 THEN 'flammable' END"),
], where="l_linenumber = 2")
_role("bulk_tanks", "part", [
    ("tank_code", "concat('T-', cast(p_partkey as string))"),
    ("material_code", "concat('M-', cast(p_partkey as string))"),
    ("quantity_kg", "cast(p_size as decimal(18,4))"),
    ("qa_status", "'Quarantine'"),
    ("lot_number", "cast(NULL as string)"),
    ("temperature_c", "cast(20 as decimal(18,4))"),
    ("status", "'idle'"),
])
_role("tank_baseline", "lineitem", [
    ("snapshot_id", _SNAPSHOT),
    ("tank_code", "concat('T-', cast(l_partkey as string))"),
    ("quantity_kg", Q4),
    ("qa_status", _MIXED_CASE),
    ("lot_number", ORDER_LINE),
    ("temperature_c", "cast(l_linenumber as decimal(18,4))"),
    ("status", "CASE WHEN l_linestatus = 'O' THEN 'filling' ELSE 'in use' END"),
], where="l_linenumber = 3")

# ------------------------------------------------------------------ registry
_role("systems", "customer", [
    ("system_id", "c_custkey"),
    ("system_key", "lower(replace(c_name, '#', '-'))"),
    ("system_name", "c_name"),
    ("domain", "lower(c_mktsegment)"),
    ("system_type", "'application'"),
    ("status", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'offline' ELSE 'active' END"),
])
_role("datasets", "events", [
    ("dataset_id", "concat(cast(user_id as string), ':', event_type)"),
    ("system_id", "user_id"),
    ("dataset_key", "concat('events.', event_type)"),
    ("dataset_name", "event_type"),
    ("domain", "'events'"),
    ("schema_name", "'events'"),
    ("object_name", "event_type"),
    ("object_type", "'collection'"),
    ("source_type", "'mongodb'"),
    ("is_active", "event_type <> 'error'"),
], distinct=True)
_role("dataset_relationships", "events", [
    ("relationship_id", "concat(cast(user_id as string), ':view->purchase')"),
    ("source_dataset_id", "concat(cast(user_id as string), ':view')"),
    ("target_dataset_id", "concat(cast(user_id as string), ':purchase')"),
    ("relationship_type", "'feeds'"),
], where="event_type = 'purchase'", distinct=True)


# ------------------------------------------------------------------- ingest
# One ingest request per user and day; each event posted with a type from the
# event kind, its own identity on two thirds of the events (else inherited
# from the request), and timestamps in the forms clients send (Z, naive,
# missing, garbage).  k is the integer in props.
_TS_Z = ("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")", "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')")
_TS_N = ("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")", "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')")


def _j(s, d):
    return (s.replace("{k}", "k"), d.replace("{k}", "k"))


_role("ingest_events", "events", prelude=[("k", _K)], columns=[
    ("source_event_id", "event_id"),
    ("batch_id", ("concat(cast(user_id as string), '@', cast(cast(ts as date) as string))",
                  "concat(cast(user_id as varchar), '@', cast(cast(ts as date) as varchar))")),
    ("batch_system_key", "concat('customer-', lpad(cast(user_id as string), 9, '0'))"),
    ("batch_system_id", "cast(NULL as string)"),
    ("raw_type", _j("CASE event_type WHEN 'error' THEN 'alert' WHEN 'click' THEN 'telemetry' WHEN 'view' THEN 'log' "
                    "WHEN 'signup' THEN (CASE WHEN {k} >= 95 THEN 'metrics' ELSE 'snapshot' END) "
                    "ELSE 'EventType.ai_interaction' END",
                    "CASE event_type WHEN 'error' THEN 'alert' WHEN 'click' THEN 'telemetry' WHEN 'view' THEN 'log' "
                    "WHEN 'signup' THEN (CASE WHEN {k} >= 95 THEN 'metrics' ELSE 'snapshot' END) "
                    "ELSE 'EventType.ai_interaction' END")),
    ("system_key", "cast(NULL as string)"),
    ("system_id", _j("CASE WHEN {k} = 0 THEN 'bad id!' WHEN {k} % 3 = 0 THEN NULL "
                     "WHEN {k} % 11 = 5 THEN cast(user_id + 100000 as string) ELSE cast(user_id as string) END",
                     "CASE WHEN {k} = 0 THEN 'bad id!' WHEN {k} % 3 = 0 THEN NULL "
                     "WHEN {k} % 11 = 5 THEN cast(user_id + 100000 as varchar) ELSE cast(user_id as varchar) END")),
    ("timestamp_text", tuple(f"CASE WHEN {k} % 4 = 0 THEN {z} WHEN {k} % 4 = 1 THEN {n} WHEN {k} % 4 = 2 THEN NULL "
                             f"WHEN {k} > 90 THEN 'not-a-time' ELSE {z} END"
                             for k, z, n in zip(("k", "k"), _TS_Z, _TS_N))),
    ("body", tuple(
        f"CASE event_type "
        f"WHEN 'click' THEN concat('{{\"metric\":\"', CASE WHEN {k} % 9 = 0 THEN '' ELSE 'clicks' END, "
        f"'\",\"value\":', cast(value as {s}), ',\"unit\":\"count\"}}') "
        f"WHEN 'error' THEN concat('{{\"severity\":\"high\",\"message\":\"error ', cast({k} as {s}), '\",\"tags\":{{\"k\":', "
        f"cast({k} as {s}), '}}}}') "
        f"WHEN 'view' THEN concat('{{\"level\":\"info\",\"message\":\"view ', cast({k} as {s}), '\",\"service\":\"web\"', "
        f"CASE WHEN {k} % 10 = 7 THEN ',\"$set\":1' ELSE '' END, '}}') "
        f"WHEN 'signup' THEN concat('{{\"snapshot_type\":\"signup\",\"state\":{{\"k\":', cast({k} as {s}), "
        f"CASE WHEN {k} % 10 = 3 THEN ',\"a.b\":2' ELSE '' END, '}}}}') "
        f"ELSE concat('{{\"role\":\"user\",\"content\":\"purchase ', cast(value as {s}), '\",\"session_id\":\"s', "
        f"cast(user_id as {s}), '\",\"context\":{{\"items\":[{{\"sku\":', cast({k} as {s}), "
        f"CASE WHEN {k} % 10 = 9 THEN ',\"$price\":1' ELSE '' END, '}}]}}}}') END"
        for k, s in zip(("k", "k"), ("string", "varchar")))),
])
