"""Remaining §2 operators as queries: F1, F5, C5, C8, C10, I3, I5, K4, K6, K8 (with oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import catalog, changes, documents, ledger
from keelson.plans.registry import query
from keelson.plans.roles import DRIVER_TABLES

C = F.col
AT = "2024-02-01 00:00:00"


# ------------------------------------------------------------------ F1 / F5
@query("capped_query", """
SELECT process_run_id, batch_id, status, started_at FROM process_runs
ORDER BY started_at DESC, process_run_id LIMIT 1000
""")
def q_capped_query(r):
    """F1 a query result capped at 1000 rows with a stated order (latest runs)."""
    df = r.process_runs.select("process_run_id", "batch_id", "status", "started_at")
    return documents.capped_query(df, 1000, [C("started_at").desc(), C("process_run_id").asc()])


@query("json_safe", """
SELECT batch_id, batch_number, CAST(target_quantity AS DOUBLE) AS target_quantity,
       CAST(actual_quantity AS DOUBLE) AS actual_quantity,
       strftime(started_at, '%Y-%m-%dT%H:%M:%S.%f') AS started_at,
       strftime(completed_at, '%Y-%m-%dT%H:%M:%S.%f') AS completed_at
FROM batches
""")
def q_json_safe(r):
    """F5 JSON-safe projection: timestamps as ISO text, decimals as double."""
    b = r.batches.select("batch_id", "batch_number", "target_quantity", "actual_quantity", "started_at",
                         "completed_at")
    return documents.json_safe(b)


# ------------------------------------------------------------------ C5 / C8 / C10
_PATCH = ("CASE WHEN toxic = 1 AND quality = 0 THEN '{\"$unset\":1}' WHEN doc_id % 5 = 0 THEN '{\"_id\":1}' "
          "ELSE concat('{\"quality\":', cast(quality as string), ',\"toxic\":', cast(toxic as string), '}') END")


@query("patch_documents", """
WITH p AS (SELECT doc_id, quality, toxic,
                  CASE WHEN toxic = 1 AND quality = 0 THEN 'Invalid field name ''$unset''.'
                       WHEN doc_id % 5 = 0 THEN 'Invalid field name ''_id''.' END AS patch_error FROM labels)
SELECT d.doc_id,
       CASE WHEN p.doc_id IS NOT NULL AND p.patch_error IS NULL
            THEN '{"doc_id":' || d.doc_id || ',"lang":"' || d.lang || '","quality":' || p.quality || ',"source":"'
                 || d.source || '","toxic":' || p.toxic || '}'
            ELSE CAST(json_object('doc_id', d.doc_id, 'lang', d.lang, 'source', d.source) AS VARCHAR) END AS doc,
       p.patch_error
FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id
""")
def q_patch_documents(r):
    """C5 $set patches from the labels applied to document JSON; bad keys refused."""
    docs = r.table("documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "source")).alias("doc"))
    patches = r.table("labels").select("doc_id", F.expr(_PATCH).alias("patch"))
    return changes.patch_documents(docs, patches, "doc_id")


@query("align_schema", """
SELECT request_id, session_id, CAST(NULL AS VARCHAR) AS reset_scope, operator, reason, status, requested_at,
       CAST(NULL AS TIMESTAMP) AS completed_at, CAST(NULL AS VARCHAR) AS admin_note, CAST(NULL AS VARCHAR) AS reviewed_by,
       CAST(NULL AS TIMESTAMP) AS reviewed_at
FROM reset_requests
""")
def q_align_schema(r):
    """C8 an old-layout request table (renamed and missing columns) aligned to the current schema."""
    current = r.reset_requests
    old = current.select("request_id", "session_id", C("operator").alias("requested_by"), "reason", "status",
                         "requested_at")
    return changes.align_schema(old, current.schema, {"requested_by": "operator"})


@query("delete_where", """
SELECT material_lot_id, status FROM material_lots WHERE NOT (status = 'blocked') OR status IS NULL
""")
def q_delete_where(r):
    """C10 blocked lots deleted (rows whose test is NULL stay)."""
    return changes.delete_where(r.material_lots.select("material_lot_id", "status"), C("status") == "blocked")


# ------------------------------------------------------------------ I3 / I5
@query("post_pick", f"""
SELECT sha256('pick|' || r.reservation_id) AS picking_transaction_id, r.reservation_id,
       CAST(r.reserved_quantity AS DOUBLE) AS picked_quantity, TIMESTAMP '{AT}' AS picked_at
FROM material_reservations r
WHERE r.status = 'reserved'
  AND NOT EXISTS (SELECT 1 FROM weighing_transactions w WHERE w.reservation_id = r.reservation_id)
""")
def q_post_pick(r):
    """I3 pick movements for reserved reservations not yet moved."""
    picks = r.weighing_transactions.select("reservation_id")
    return ledger.post_pick(r.material_reservations, picks, F.lit(AT).cast("timestamp_ntz"))["picks"]


@query("post_weigh", """
WITH w AS (SELECT reservation_id, bool_and(tare_confirmed) AS t FROM weighing_transactions GROUP BY reservation_id)
SELECT r.reservation_id, r.status AS previous_status,
       CASE WHEN COALESCE(w.t, FALSE) THEN 'weighed' ELSE r.status END AS status,
       CASE WHEN NOT COALESCE(w.t, FALSE) THEN 'Tare must be confirmed before weighing is recorded.' END AS reason
FROM material_reservations r JOIN w ON w.reservation_id = r.reservation_id
WHERE r.status IN ('reserved', 'picked')
""")
def q_post_weigh(r):
    """I3 weighing recorded only with a confirmed tare."""
    return ledger.post_weigh(r.material_reservations, r.weighing_transactions)


@query("complete_request", """
WITH per AS (SELECT material_request_id, COUNT(*) AS lines,
                    COUNT(*) FILTER (WHERE issued_quantity >= requested_quantity) AS issued_lines
             FROM material_request_lines GROUP BY material_request_id),
last AS (SELECT material_request_id, max(issued_at) AS t FROM material_issues GROUP BY material_request_id)
SELECT mr.material_request_id, mr.request_number, COALESCE(per.lines, 0) AS lines,
       COALESCE(per.issued_lines, 0) AS issued_lines,
       CASE WHEN per.lines > 0 AND per.lines = per.issued_lines THEN 'fulfilled' ELSE mr.status END AS status,
       CASE WHEN per.lines > 0 AND per.lines = per.issued_lines THEN last.t ELSE mr.fulfilled_at END AS fulfilled_at
FROM material_requests mr
LEFT JOIN per ON per.material_request_id = mr.material_request_id
LEFT JOIN last ON last.material_request_id = mr.material_request_id
""")
def q_complete_request(r):
    """I5 requests whose lines are all issued become fulfilled at the last issue time."""
    return ledger.complete_request(r.material_requests, r.material_request_lines, r.material_issues)


# ------------------------------------------------------------------ K4 / K6 / K8
@query("discover", "\nUNION ALL\n".join(
    f"SELECT 'parquet.default.{t}' AS dataset_key, '{t}' AS object_name, "
    f"(SELECT COUNT(*) FROM information_schema.columns WHERE table_name = '{t}') AS column_count, "
    f"(SELECT COUNT(*) FROM {t}) AS estimated_rows" for t in sorted(DRIVER_TABLES)))
def q_discover(r):
    """K4 every table of the scale-factor folder: key, name, column count, rows."""
    paths = {t: f"{r.sf_dir}/{t}.parquet" for t in DRIVER_TABLES}
    return catalog.discover(r.spark, paths).withColumn("column_count", C("column_count").cast("long"))


@query("registry_list", """
SELECT system_id, dataset_id, schema_name, object_name, dataset_name FROM datasets
ORDER BY system_id, schema_name, object_name, dataset_name
""")
def q_registry_list(r):
    """K6 datasets by system, schema, object and name."""
    _, ds = catalog.registry_list(r.systems, r.datasets)
    return ds.select("system_id", "dataset_id", "schema_name", "object_name", "dataset_name")


@query("add_relationship", """
WITH cand AS (
  SELECT DISTINCT concat(CAST(user_id AS VARCHAR), ':', 'click->purchase') AS relationship_id,
         concat(CAST(user_id AS VARCHAR), ':', CASE event_type WHEN 'error' THEN 'purchase' WHEN 'view' THEN 'view'
                                                ELSE 'click' END) AS source_dataset_id,
         concat(CAST(user_id AS VARCHAR), ':purchase') AS target_dataset_id, 'feeds' AS relationship_type
  FROM events WHERE event_type IN ('click', 'error', 'view')),
firsts AS (SELECT source_dataset_id, target_dataset_id, relationship_type, min(relationship_id) AS relationship_id
           FROM cand WHERE source_dataset_id <> target_dataset_id GROUP BY 1, 2, 3)
SELECT relationship_id, source_dataset_id, target_dataset_id, relationship_type FROM firsts f
WHERE NOT EXISTS (SELECT 1 FROM dataset_relationships x WHERE x.source_dataset_id = f.source_dataset_id
                  AND x.target_dataset_id = f.target_dataset_id AND x.relationship_type = f.relationship_type)
""")
def q_add_relationship(r):
    """K8 new relationships: unique triple, no self link."""
    ev = r.table("events").where(C("event_type").isin("click", "error", "view"))
    u = C("user_id").cast("string")
    cand = ev.select(F.concat(u, F.lit(":click->purchase")).alias("relationship_id"),
                     F.concat(u, F.lit(":"), F.when(C("event_type") == "error", F.lit("purchase"))
                              .when(C("event_type") == "view", F.lit("view"))
                              .otherwise(F.lit("click"))).alias("source_dataset_id"),
                     F.concat(u, F.lit(":purchase")).alias("target_dataset_id"),
                     F.lit("feeds").alias("relationship_type")).distinct()
    return catalog.add_relationship(r.dataset_relationships, cand)


# ------------------------------------------------------------------ D2/D4/D5/D6, C9 set, I11 lines, L1
@query("doc_add_fields", """
SELECT doc_id, lang, n_chars, n_chars > 1000 AS is_long, upper(substr(source, 1, 3)) AS source_prefix FROM documents
""")
def q_doc_add_fields(r):
    """D2 $addFields: computed fields next to the existing ones."""
    d = r.table("documents").select("doc_id", "lang", "n_chars", "source")
    out = documents.doc_add_fields(d, {"is_long": C("n_chars") > 1000,
                                       "source_prefix": F.upper(F.substring("source", 1, 3))})
    return out.drop("source")


@query("doc_sort", """
SELECT doc_id, lang, n_chars FROM documents ORDER BY lang NULLS FIRST, n_chars DESC NULLS LAST, doc_id
""")
def q_doc_sort(r):
    """D4 $sort over the whole collection (range-partitioned global sort)."""
    return documents.doc_sort(r.table("documents").select("doc_id", "lang", "n_chars"),
                              [("lang", 1), ("n_chars", -1)], "doc_id")


@query("doc_skip_limit", """
SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 25 OFFSET 10
""")
def q_doc_skip_limit(r):
    """D5 $sort + $skip 10 + $limit 25."""
    d = documents.doc_sort(r.table("documents").select("doc_id", "lang", "n_chars"), [("n_chars", -1)], "doc_id")
    return documents.doc_limit(d, 25, skip=10)


@query("doc_count", "SELECT COUNT(*) AS matched FROM documents WHERE lang = 'de'")
def q_doc_count(r):
    """D6 $match + $count."""
    return documents.doc_count(documents.doc_match(r.table("documents"), C("lang") == "de"), "matched")


@query("json_set", """
SELECT event_id,
       CASE WHEN event_type = 'error' THEN '{"k":' || json_extract_string(props, '$.k') || ',"reviewed":true}'
            ELSE props END AS props
FROM events
""")
def q_json_set(r):
    """C9 jsonb_set of one top-level key on error events."""
    e = r.table("events")
    return e.select("event_id", F.when(C("event_type") == "error",
                                       changes.json_set(C("props"), "reviewed", F.lit(True)))
                    .otherwise(C("props")).alias("props"))


@query("derive_po_lines", """
WITH po AS (SELECT supplier_id AS purchase_order_id, supplier_id, TIMESTAMP '2024-01-01 00:00:00' AS ordered_at
            FROM suppliers WHERE status = 'approved'),
lines AS (SELECT CAST(po.purchase_order_id AS VARCHAR) || '|' || CAST(mc.supply_material_id AS VARCHAR)
                     AS purchase_order_line_id, po.purchase_order_id, mc.supply_material_id,
                 CAST(mc.reorder_quantity AS DOUBLE) AS ordered_quantity, mc.unit_of_measure
          FROM po JOIN material_catalog mc ON mc.preferred_supplier_id = po.supplier_id WHERE mc.active)
SELECT * FROM lines l
WHERE NOT EXISTS (SELECT 1 FROM material_lots x WHERE x.status = 'released'
                  AND x.supplier_id = l.purchase_order_id AND x.supply_material_id = l.supply_material_id)
""")
def q_derive_po_lines(r):
    """I11 purchase-order lines for the preferred supplier's materials, skipping pairs already received."""
    po = r.suppliers.where(C("status") == "approved").select(
        C("supplier_id").alias("purchase_order_id"), "supplier_id",
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ordered_at"))
    existing = r.material_lots.where(C("status") == "released").select(
        C("supplier_id").alias("purchase_order_id"), "supply_material_id")
    return ledger.derive_po_lines(po, r.material_catalog, existing)


@query("csv_source", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
       CAST(o_totalprice AS VARCHAR) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
       o_orderpriority
FROM orders
""")
def q_csv_source(r):
    """L1 orders written as a semicolon file with a BOM header in the shared folder, read back as text."""
    import uuid
    from keelson.session import scratch_path
    from keelson.sources import csv as csvsrc
    path = scratch_path(r.spark, f"csv-{uuid.uuid4().hex}")
    o = r.table("orders").selectExpr("cast(o_orderkey as string) as `﻿O_OrderKey`", "o_custkey AS `O CustKey`",
                                     "o_orderstatus", "cast(o_totalprice as string) as o_totalprice",
                                     "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') as o_orderdate",
                                     "o_orderpriority")
    o.write.option("header", True).option("sep", ";").csv(path)
    return csvsrc.csv_source(r.spark, path)  # header names normalised: o_orderkey, o_custkey, ...
