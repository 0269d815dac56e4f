"""Inventory ledger (I1-I11): balances, reservation, issue, readiness, events.

The reference runs these one row at a time inside procedural blocks; here
each is one set-based step over whole batches of lines.  Stated choices:

* ``reserve``: a lot whose *total* new demand exceeds its available quantity
  is a shortage for every line on it (no partial, order-dependent fill).
* ``post_issue``: the depletion test uses the lot's reserved quantity
  *before* subtracting, as the reference's UPDATE does.
* Everything is idempotent: lines, reservations and events already present
  are skipped with ``left_anti`` joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.operators.changes import absent, insert_if_absent, upsert
from keelson.operators.ordering import running_by_key

C = F.col
DEC = "decimal(18,4)"


def lot_balances(material_lots: DataFrame, material_reservations: DataFrame, material_issues: DataFrame) -> DataFrame:
    """Recompute reserved / available / status of every lot from the ledger.

    Lots, open reservations and issues are tagged and unioned, then summed per lot
    in one aggregate: one shuffle for the three inputs instead of two
    grouped frames plus two joins.  ``material_lot_id`` is the lots' key.
    """
    z = F.lit(None).cast(DEC)
    no_num = F.lit(None).cast("string")
    lots = material_lots.select("material_lot_id", "internal_lot_number", C("received_quantity").cast(DEC).alias("_rcv"),
                                z.alias("_open"), z.alias("_iss"), F.lit(1).alias("_lot"))
    res = material_reservations.where(C("status") == "reserved").select(
        "material_lot_id", no_num.alias("internal_lot_number"), z.alias("_rcv"),
        C("reserved_quantity").cast(DEC).alias("_open"), z.alias("_iss"), F.lit(0).alias("_lot"))
    iss = material_issues.select("material_lot_id", no_num.alias("internal_lot_number"), z.alias("_rcv"),
                                 z.alias("_open"), C("issued_quantity").cast(DEC).alias("_iss"), F.lit(0).alias("_lot"))
    g = (lots.unionByName(res).unionByName(iss).groupBy("material_lot_id")
         .agg(F.max("internal_lot_number").alias("internal_lot_number"), F.sum("_rcv").alias("_rcv"),
              F.sum("_open").alias("_open"), F.sum("_iss").alias("_issued"), F.sum("_lot").alias("_lots"))
         .where(C("_lots") > 0))
    open_ = F.coalesce(C("_open"), F.lit(0)).cast(DEC)
    issued = F.coalesce(C("_issued"), F.lit(0)).cast(DEC)
    received = C("_rcv").cast(DEC)
    rest = received - issued - open_
    return g.select(
        "material_lot_id", "internal_lot_number", received.alias("received_quantity"),
        issued.alias("issued_quantity"), open_.alias("reserved_quantity"),
        F.greatest(rest, F.lit(0)).cast(DEC).alias("available_quantity"),
        F.when(rest <= 0, "depleted").when(open_ > 0, "reserved").otherwise("released").alias("status"))


def reserve(lines: DataFrame, lots: DataFrame, reservations: DataFrame, reserved_at: Column) -> dict:
    """Reserve requested quantities on the chosen lots.

    ``lines``: material_request_line_id, material_lot_id, requested_quantity.
    Lines that already hold a reservation are skipped.  Returns
    ``outcome`` (line, lot, quantity, reserved|shortage), ``reservations``
    (new rows) and ``lots`` (new state of the touched lots).
    """
    new = absent(lines, reservations, "material_request_line_id")
    demand = new.groupBy("material_lot_id").agg(F.sum("requested_quantity").alias("_demand"))
    lot_ok = (lots.select("material_lot_id", "available_quantity", "reserved_quantity")
              .join(demand, "material_lot_id")
              .withColumn("_short", C("_demand") > C("available_quantity")))
    outcome = (new.join(lot_ok.select("material_lot_id", "_short"), "material_lot_id", "left")
               .select("material_request_line_id", "material_lot_id", "requested_quantity",
                       F.when(F.coalesce(C("_short"), F.lit(True)), "shortage").otherwise("reserved").alias("outcome")))
    new_res = outcome.where(C("outcome") == "reserved").select(
        F.sha2(F.concat_ws("|", F.lit("reservation"), C("material_request_line_id")), 256).alias("reservation_id"),
        "material_request_line_id", "material_lot_id", C("requested_quantity").alias("reserved_quantity"),
        F.lit("reserved").alias("status"), reserved_at.alias("reserved_at"))
    lots_new = lot_ok.where(~C("_short")).select(
        "material_lot_id", (C("available_quantity") - C("_demand")).cast(DEC).alias("available_quantity"),
        (C("reserved_quantity") + C("_demand")).cast(DEC).alias("reserved_quantity"),
        F.lit("reserved").alias("status"))
    return {"outcome": outcome, "reservations": new_res, "lots": lots_new}


def post_issue(to_issue: DataFrame, issues: DataFrame, lots: DataFrame, issued_at: Column) -> dict:
    """I4: issue each reservation once and release its quantity from the lot.

    ``to_issue``: reservation_id, material_lot_id, reserved_quantity (and
    any context columns).  Lot: reserved = greatest(reserved - q, 0); status
    'depleted' when available <= 0 and reserved - q <= 0 (old reserved), else
    'available'.
    """
    new = absent(to_issue, issues, "reservation_id")
    new_issues = new.select(
        F.sha2(F.concat_ws("|", F.lit("issue"), C("reservation_id")), 256).alias("material_issue_id"),
        "reservation_id", "material_lot_id", C("reserved_quantity").cast(DEC).alias("issued_quantity"),
        issued_at.alias("issued_at"))
    q = new_issues.groupBy("material_lot_id").agg(F.sum("issued_quantity").alias("_q"), F.count(F.lit(1)).alias("_n"))
    j = lots.select("material_lot_id", "available_quantity", "reserved_quantity").join(q, "material_lot_id")
    after = C("reserved_quantity") - C("_q")
    lots_new = j.select(
        "material_lot_id", C("_n").alias("issues_posted"), C("_q").cast(DEC).alias("issued_quantity"),
        "available_quantity", F.greatest(after, F.lit(0)).cast(DEC).alias("reserved_quantity"),
        F.when((C("available_quantity") <= 0) & (after <= 0), "depleted").otherwise("available").alias("status"))
    return {"issues": new_issues, "lots": lots_new}


def ready_batches(batches: DataFrame, batch_materials: DataFrame, candidate_statuses=("packaging",)) -> DataFrame:
    """Batches with no material whose weighing status is not 'verified' move to 'mixing'.

    A batch with no materials passes (NOT EXISTS).  Returns every batch with
    ``ready`` and the new ``status``.
    """
    blocking = batch_materials.where(C("weighing_status") != "verified").select("batch_id").distinct()
    flagged = batches.select("batch_id", "batch_number", "status").join(
        blocking.withColumn("_blocked", F.lit(True)), "batch_id", "left")
    ready = C("_blocked").isNull()
    return flagged.select(
        "batch_id", "batch_number", C("status").alias("previous_status"), ready.alias("ready"),
        F.when(ready & C("status").isin(list(candidate_statuses)), F.lit("mixing")).otherwise(C("status"))
        .alias("status"))


def derive_request_lines(batch_materials, material_requests, materials, material_catalog, existing_lines):
    """One request line per batch material; issued = coalesce(actual, required) when the request is issued.

    Materials that have a line drop out first, so only the rest meets the requests and the catalog;
    the line id, longer than the row, is made after the last shuffle.
    """
    done = existing_lines.select(C("pharma_batch_material_id").alias("batch_material_id"))
    bm = (batch_materials.select("batch_material_id", "batch_id", "material_id", "required_quantity",
                                 "actual_quantity", "unit_of_measure")
          .join(done, "batch_material_id", "left_anti"))
    mr = material_requests.select("material_request_id", C("pharma_batch_id").alias("batch_id"),
                                  C("status").alias("_req_status"))
    mc = (materials.select("material_id", "material_code")
          .join(material_catalog.select("material_code", "supply_material_id"), "material_code"))
    issued = C("_req_status") == "issued"
    return (bm.join(mr, "batch_id").drop("batch_id").join(mc, "material_id")
            .select(C("batch_material_id").alias("pharma_batch_material_id"),
                    F.sha2(F.concat_ws("|", F.lit("line"), C("batch_material_id")), 256)
                    .alias("material_request_line_id"),
                    "material_request_id", "supply_material_id",
                    C("required_quantity").alias("requested_quantity"),
                    F.when(issued, F.coalesce(C("actual_quantity"), C("required_quantity")))
                    .otherwise(F.lit(0)).cast(DEC).alias("issued_quantity"),
                    "unit_of_measure", F.when(issued, "issued").otherwise("requested").alias("status")))


def derive_reservations(request_lines, material_requests, lot_of_line: DataFrame, existing) -> DataFrame:
    """I8: one reservation per line, reserved 30 minutes after the request."""
    rq = material_requests.select("material_request_id", "requested_at", C("status").alias("_rs"))
    j = (request_lines.select("material_request_line_id", "material_request_id", "requested_quantity")
         .join(rq, "material_request_id").join(lot_of_line, "material_request_line_id"))
    out = j.select(F.sha2(F.concat_ws("|", F.lit("reservation"), C("material_request_line_id")), 256)
                   .alias("reservation_id"), "material_request_line_id", "material_lot_id",
                   C("requested_quantity").alias("reserved_quantity"),
                   F.when(C("_rs") == "issued", "issued").otherwise("reserved").alias("status"),
                   (C("requested_at") + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(30),
                                                         F.lit(0))).alias("reserved_at"))
    return out.join(existing.select("material_request_line_id").distinct(), "material_request_line_id", "left_anti")


def derive_receipts(material_lots: DataFrame, po_lines: DataFrame, receipts: DataFrame) -> DataFrame:
    """One receipt per lot, matched to the order line on material *and* preferred supplier.

    Lots that already have a receipt are skipped.
    """
    lots = material_lots.select("material_lot_id", "supply_material_id", "supplier_id", "received_quantity",
                                "received_at")
    pol = po_lines.select("purchase_order_line_id", "supply_material_id", "supplier_id")
    j = lots.join(pol, ["supply_material_id", "supplier_id"])
    out = j.select(F.concat(F.lit("RC-"), C("material_lot_id")).alias("receipt_id"), "purchase_order_line_id",
                   "material_lot_id", "supplier_id", "received_quantity", "received_at")
    return out.join(receipts.select("material_lot_id").distinct(), "material_lot_id", "left_anti")


def emit_events_once(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Append an event per (correlation_id, event_type) not seen before.

    ``candidates``: correlation_id, event_type, payload (JSON text), event_timestamp.
    Duplicates inside the batch keep the smallest payload (deterministic).
    """
    fresh = insert_if_absent(existing.select("correlation_id", "event_type"), candidates,
                             ["correlation_id", "event_type"])
    return fresh.select(F.sha2(F.concat_ws("|", "correlation_id", "event_type"), 256).alias("event_id"),
                        *candidates.columns)


def sync_state(state: DataFrame, processed: DataFrame, direction: str = "outbound") -> DataFrame:
    """Upsert the per (system, dataset) sync state from a processed batch summary.

    ``processed``: system_key, dataset_key, records_processed, attempted_at.
    Matched keys get success/attempt time, status 'success', the new count
    and error NULL; new keys are inserted.
    """
    src = processed.select(
        "system_key", "dataset_key",
        F.concat_ws(":", "system_key", "dataset_key").alias("sync_id"),
        F.lit(direction).alias("sync_direction"),
        C("attempted_at").alias("last_success_at"), C("attempted_at").alias("last_attempt_at"),
        F.lit("success").alias("last_status"), C("records_processed").cast("long").alias("records_processed"),
        F.lit(None).cast("string").alias("last_error"))
    return upsert(state, src, ["system_key", "dataset_key"],
                  update_cols=["last_success_at", "last_attempt_at", "last_status", "records_processed", "last_error"])


def post_pick(reservations: DataFrame, picks: DataFrame, picked_at: Column) -> dict:
    """I3 pick: one picking movement per reserved reservation, once; status -> picked."""
    todo = absent(reservations.where(C("status") == "reserved"), picks, "reservation_id")
    moves = todo.select(F.sha2(F.concat_ws("|", F.lit("pick"), C("reservation_id")), 256).alias("picking_transaction_id"),
                        "reservation_id", C("reserved_quantity").alias("picked_quantity"), picked_at.alias("picked_at"))
    hit = moves.select("reservation_id", F.lit(True).alias("_picked"))
    state = (reservations.join(hit, "reservation_id", "left")
             .withColumn("status", F.when(C("_picked"), F.lit("picked")).otherwise(C("status"))).drop("_picked"))
    return {"picks": moves, "reservations": state}


def post_weigh(reservations: DataFrame, weighings: DataFrame) -> DataFrame:
    """I3 weigh: picked/reserved reservations with a weighing move to 'weighed' when the tare is confirmed.

    Returns one row per weighed candidate: reservation_id, status, reason
    (tare not confirmed -> stays, with the reason).
    """
    w = weighings.groupBy("reservation_id").agg(F.bool_and(C("tare_confirmed")).alias("_tare"),
                                                F.count(F.lit(1)).alias("_weighings"))
    cand = reservations.where(C("status").isin("reserved", "picked")).select("reservation_id", "status") \
        .join(w, "reservation_id")
    ok = F.coalesce(C("_tare"), F.lit(False))
    return cand.select("reservation_id", C("status").alias("previous_status"),
                       F.when(ok, F.lit("weighed")).otherwise(C("status")).alias("status"),
                       F.when(~ok, F.lit("Tare must be confirmed before weighing is recorded.")).alias("reason"))


def complete_request(requests: DataFrame, lines: DataFrame, issues: DataFrame) -> DataFrame:
    """A request whose every line has issued >= requested is fulfilled at its last issue time."""
    per = lines.groupBy("material_request_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(C("issued_quantity") >= C("requested_quantity")).alias("issued_lines"))
    last = issues.groupBy("material_request_id").agg(F.max("issued_at").alias("_last"))
    j = requests.select("material_request_id", "request_number", "status", "fulfilled_at") \
        .join(per, "material_request_id", "left").join(last, "material_request_id", "left")
    done = (C("lines") > 0) & (C("lines") == C("issued_lines"))
    return j.select("material_request_id", "request_number",
                    F.coalesce(C("lines"), F.lit(0)).cast("long").alias("lines"),
                    F.coalesce(C("issued_lines"), F.lit(0)).cast("long").alias("issued_lines"),
                    F.when(done, F.lit("fulfilled")).otherwise(C("status")).alias("status"),
                    F.when(done, C("_last")).otherwise(C("fulfilled_at")).alias("fulfilled_at"))


def derive_po_lines(purchase_orders: DataFrame, material_catalog: DataFrame, existing: DataFrame) -> DataFrame:
    """I11 order lines: one per catalog material whose preferred supplier is the order's supplier; skip existing."""
    po = purchase_orders.select("purchase_order_id", "supplier_id", "ordered_at")
    mc = material_catalog.where(C("active")).select("supply_material_id", C("preferred_supplier_id").alias("supplier_id"),
                                                    "reorder_quantity", "unit_of_measure")
    lines = po.join(mc, "supplier_id").select(
        F.concat_ws("|", C("purchase_order_id").cast("string"), C("supply_material_id").cast("string"))
        .alias("purchase_order_line_id"), "purchase_order_id", "supply_material_id",
        C("reorder_quantity").alias("ordered_quantity"), "unit_of_measure")
    return lines.join(existing.select("purchase_order_id", "supply_material_id").distinct(),
                      ["purchase_order_id", "supply_material_id"], "left_anti")


RES_COLS = ["reservation_id", "material_request_line_id", "material_lot_id", "reserved_quantity", "status"]
ISSUE_COLS = ["material_issue_id", "reservation_id", "material_lot_id", "issued_quantity"]


def ledger_cycle(lines: DataFrame, lots: DataFrame, reservations: DataFrame, issues: DataFrame, at: Column,
                 cut=None, cut_states: bool = True) -> dict:
    """One set-based supply cycle: reserve new lines, issue what was reserved, recompute balances.

    ``lots``: material_lot_id, internal_lot_number, received_quantity,
    available_quantity, reserved_quantity.  ``reservations`` / ``issues`` are
    the ledgers (RES_COLS / ISSUE_COLS); lines whose only reservation was
    cancelled are reserved again.  New rows and each new ledger state are passed
    through ``cut`` (e.g. ``keelson.session.cut_lineage``) so the following
    steps start from a checkpoint.  ``cut_states=False`` cuts the new rows alone:
    the states are then the ledgers as given and the new rows, for a caller that
    has no further cycle to run on them.  Running the cycle again on its own output
    changes nothing (every step skips what is already recorded).
    """
    cut = cut or (lambda d: d)
    cut_state = cut if cut_states else (lambda d: d)
    # A cancelled reservation no longer holds its line.
    r = reserve(lines, lots, reservations.where(C("status") != "cancelled"), at)
    # Cut first: later steps read them, and each would run the whole reservation again.
    new_res = cut(r["reservations"].select(*RES_COLS))
    to_issue = new_res.select("reservation_id", "material_lot_id", "reserved_quantity")
    new_issues = cut(post_issue(to_issue, issues, lots, at)["issues"].select(*ISSUE_COLS))
    issued_ids = new_issues.select("reservation_id", F.lit(True).alias("_issued"))
    all_res = reservations.select(*RES_COLS).unionByName(new_res)
    res_state = cut_state(all_res.join(issued_ids, "reservation_id", "left")
                          .withColumn("status", F.when(C("_issued"), F.lit("issued")).otherwise(C("status")))
                          .drop("_issued"))
    all_issues = issues.select(*ISSUE_COLS).unionByName(new_issues)
    issue_state = cut_state(all_issues)
    # Balances count what is still reserved, so no other reservation has to meet the new issues.
    still_open = all_res.where(C("status") == "reserved").join(issued_ids, "reservation_id", "left_anti")
    balances = lot_balances(lots.select("material_lot_id", "internal_lot_number", "received_quantity"),
                            still_open, all_issues)
    return {"outcome": r["outcome"], "reservations": res_state, "issues": issue_state, "balances": balances}


def running_total(df: DataFrame, key: str, ts: str, tiebreak: str, value: str) -> DataFrame:
    """``df`` with ``running_total``, the exact running SUM(value) per key in (ts, tiebreak) order."""
    return running_by_key(df, key, [ts, tiebreak], value)


def reserve_in_order(lines: DataFrame, lots: DataFrame, reservations: DataFrame) -> DataFrame:
    """I2, one-at-a-time variant: per lot, lines are reserved in request order while the
    running demand fits the available quantity; from the first line that does not
    fit, every later line on that lot is a shortage (the reference stops there).

    ``lines``: material_request_line_id, material_lot_id, requested_quantity, requested_at.
    """
    new = absent(lines, reservations, "material_request_line_id")
    ordered = running_total(new, "material_lot_id", "requested_at", "material_request_line_id", "requested_quantity")
    avail = lots.select("material_lot_id", "available_quantity")
    return (ordered.join(avail, "material_lot_id", "left")
            .select("material_request_line_id", "material_lot_id", "requested_quantity", "requested_at",
                    C("running_total").cast(DEC).alias("running_demand"),
                    F.when(C("running_total") <= C("available_quantity"), "reserved").otherwise("shortage")
                    .alias("outcome")))
