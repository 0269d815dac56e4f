"""Idempotence and conservation properties of the change and ledger operators."""

import datetime as dt
import hashlib
from decimal import Decimal

from pyspark.sql import functions as F

from keelson.operators import changes, ledger


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_and_insert_if_absent_idempotent(spark):
    t = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k long, name string, v long")
    s = spark.createDataFrame([(2, "B", 21), (3, "c", 30)], "k long, name string, v long")
    once = changes.upsert(t, s, "k", update_cols=["v"], keep_first=["name"])
    twice = changes.upsert(once, s, "k", update_cols=["v"], keep_first=["name"])
    assert _sorted(once) == _sorted(twice) == [(1, "a", 10), (2, "b", 21), (3, "c", 30)]
    new = changes.insert_if_absent(once, s, "k")
    assert new.count() == 0


def test_update_from_counts_changes_null_safely(spark):
    t = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k long, lot string")
    s = spark.createDataFrame([(1, None), (2, "z"), (3, "y")], "k long, lot string")
    out = {r.k: r for r in changes.update_from(t, s, "k", ["lot"]).collect()}
    assert [out[i].changed for i in (1, 2, 3)] == [False, True, False]
    assert out[2].lot == "z"


def test_delete_where_keeps_null_tests(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x long")
    assert changes.delete_where(df, F.col("x") > 2).count() == 2


def test_reserve_conservation_and_idempotence(spark):
    lots = spark.createDataFrame([("L1", Decimal("10.0000"), Decimal("0.0000")), ("L2", Decimal("5.0000"), Decimal("0.0000"))],
                                 "material_lot_id string, available_quantity decimal(18,4), reserved_quantity decimal(18,4)")
    lines = spark.createDataFrame([("a", "L1", Decimal("4.0000")), ("b", "L1", Decimal("5.0000")),
                                   ("c", "L2", Decimal("3.0000")), ("d", "L2", Decimal("3.0000"))],
                                  "material_request_line_id string, material_lot_id string, requested_quantity decimal(18,4)")
    none = spark.createDataFrame([], "material_request_line_id string")
    now = F.lit(dt.datetime(2024, 2, 1))
    out = ledger.reserve(lines, lots, none, now)
    oc = {r.material_request_line_id: r.outcome for r in out["outcome"].collect()}
    assert oc == {"a": "reserved", "b": "reserved", "c": "shortage", "d": "shortage"}  # L2 total 6 > 5
    l1 = out["lots"].collect()[0]
    assert l1.available_quantity + l1.reserved_quantity == Decimal("10.0000")
    again = ledger.reserve(lines, lots, out["reservations"], now)
    assert {r.material_request_line_id for r in again["outcome"].collect()} == {"c", "d"}


def test_emit_events_once(spark):
    cand = spark.createDataFrame([("c1", "created", "{}"), ("c1", "created", '{"x":1}'), ("c2", "created", "{}")],
                                 "correlation_id string, event_type string, payload string")
    seen = spark.createDataFrame([("c2", "created")], "correlation_id string, event_type string")
    out = ledger.emit_events_once(cand, seen).collect()
    assert [(r.correlation_id, r.payload) for r in out] == [("c1", '{"x":1}')]  # smallest row wins


def test_json_merge(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"c":2},"s":"t"}', '{"a":5,"d":true}')], "l string, r string")
    assert df.select(changes.json_merge(F.col("l"), F.col("r"))).first()[0] == '{"a":5,"b":{"c":2},"d":true,"s":"t"}'


def test_ledger_cycle_idempotent_with_checkpoints(spark):
    from keelson.session import cut_lineage
    lots = spark.createDataFrame(
        [("L1", "n1", Decimal("10.0000"), Decimal("10.0000"), Decimal("0.0000")),
         ("L2", "n2", Decimal("5.0000"), Decimal("5.0000"), Decimal("0.0000"))],
        "material_lot_id string, internal_lot_number string, received_quantity decimal(18,4), "
        "available_quantity decimal(18,4), reserved_quantity decimal(18,4)")
    lines = spark.createDataFrame([("a", "L1", Decimal("4.0000")), ("b", "L2", Decimal("6.0000"))],
                                  "material_request_line_id string, material_lot_id string, requested_quantity decimal(18,4)")
    res0 = spark.createDataFrame([], "reservation_id string, material_request_line_id string, material_lot_id string, "
                                     "reserved_quantity decimal(18,4), status string")
    iss0 = spark.createDataFrame([], "material_issue_id string, reservation_id string, material_lot_id string, "
                                     "issued_quantity decimal(18,4)")
    at = F.lit(dt.datetime(2024, 2, 1))
    one = ledger.ledger_cycle(lines, lots, res0, iss0, at, cut=cut_lineage)
    bal = {r.material_lot_id: r for r in one["balances"].collect()}
    assert bal["L1"].issued_quantity == Decimal("4.0000") and bal["L1"].available_quantity == Decimal("6.0000")
    assert bal["L2"].issued_quantity == Decimal("0.0000")  # shortage: 6 > 5, nothing reserved
    two = ledger.ledger_cycle(lines, lots, one["reservations"], one["issues"], at, cut=cut_lineage)
    assert _sorted(two["balances"]) == _sorted(one["balances"])
    assert two["issues"].count() == one["issues"].count() == 1


def test_ledger_cycle_cuts_new_rows_before_the_states_read_them(spark):
    lots = spark.createDataFrame([("L1", "n1", Decimal("9.0000"), Decimal("9.0000"), Decimal("0.0000"))],
                                 "material_lot_id string, internal_lot_number string, received_quantity decimal(18,4), "
                                 "available_quantity decimal(18,4), reserved_quantity decimal(18,4)")
    lines = spark.createDataFrame([("a", "L1", Decimal("4.0000"))],
                                  "material_request_line_id string, material_lot_id string, requested_quantity decimal(18,4)")
    res = spark.createDataFrame([("r", "z", "L1", Decimal("1.0000"), "reserved")],
                                "reservation_id string, material_request_line_id string, material_lot_id string, "
                                "reserved_quantity decimal(18,4), status string")
    iss = spark.createDataFrame([], "material_issue_id string, reservation_id string, material_lot_id string, "
                                    "issued_quantity decimal(18,4)")
    cuts = []
    ledger.ledger_cycle(lines, lots, res, iss, F.lit(dt.datetime(2024, 2, 1)), cut=lambda d: cuts.append(d.count()) or d)
    assert cuts == [1, 1, 2, 1]     # the new reservation, its issue, then both ledgers


LOT = "material_lot_id string, internal_lot_number string, received_quantity decimal(18,4), " \
      "available_quantity decimal(18,4), reserved_quantity decimal(18,4)"
RES = "reservation_id string, material_request_line_id string, material_lot_id string, " \
      "reserved_quantity decimal(18,4), status string"


def test_ledger_cycle_balances_do_not_need_the_states_cut(spark):
    q = lambda v: Decimal(f"{v}.0000")
    lots = spark.createDataFrame([("L1", "n1", q(9), q(9), q(0)), ("L2", "n2", q(5), q(5), q(0)), (None, "n3", q(2), q(2), q(0))], LOT)
    lines = spark.createDataFrame([("a", "L1", q(4)), ("b", "L2", q(1))],
                                  "material_request_line_id string, material_lot_id string, requested_quantity decimal(18,4)")
    id_a = hashlib.sha256(b"reservation|a").hexdigest()
    # An open reservation with the id of the new one is issued with it; the others stay, with or without id and status.
    res = spark.createDataFrame([(id_a, "z", "L1", q(1), "reserved"), ("r2", "y", "L1", q(2), "reserved"),
                                 (None, "x", "L2", q(1), "reserved"), ("r4", "w", "L2", q(3), "issued"),
                                 ("r5", "v", "L2", q(1), None), ("r6", "u", None, q(1), "reserved")], RES)
    iss = spark.createDataFrame([("i4", "r4", "L2", q(3))], "material_issue_id string, reservation_id string, "
                                                            "material_lot_id string, issued_quantity decimal(18,4)")
    got = {}
    for cut_states in (True, False):
        cuts = []
        out = ledger.ledger_cycle(lines, lots, res, iss, F.lit(dt.datetime(2024, 2, 1)),
                                  cut=lambda d: cuts.append(d.count()) or d, cut_states=cut_states)
        assert cuts == ([2, 2, 8, 3] if cut_states else [2, 2])
        got[cut_states] = [sorted(map(tuple, out[k].collect()), key=str) for k in ("balances", "reservations", "issues")]
    assert got[True] == got[False]
    balances = {r[0]: tuple(map(int, r[2:6])) for r in got[False][0]}       # received, issued, reserved, available
    assert balances == {"L1": (9, 4, 2, 3), "L2": (5, 4, 1, 0), None: (2, 0, 1, 1)}


def test_ledger_cycle_query_stores_the_new_rows_alone(spark, monkeypatch):
    from keelson import session
    from keelson.plans.registry import load_all
    cuts, cut = [], session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: cuts.append(df.columns) or cut(df))
    df = load_all()[0]["ledger_cycle"](spark, "/root/testdata/sf0.001")
    assert cuts == [ledger.RES_COLS, ledger.ISSUE_COLS]
    assert df.count() > 0


def test_lot_balances_leave_closed_reservations_out_before_the_shuffle(spark):
    lots = spark.createDataFrame([("L1", "n1", Decimal("9.0000"), Decimal("9.0000"), Decimal("0.0000"))], LOT)
    res = spark.createDataFrame([("r1", "a", "L1", Decimal("1.0000"), "reserved"), ("r2", "b", "L1", Decimal("2.0000"), "issued"),
                                 ("r3", "c", "L1", Decimal("4.0000"), None)], RES)
    iss = spark.createDataFrame([], "material_lot_id string, issued_quantity decimal(18,4)")
    out = ledger.lot_balances(lots, res, iss)
    node = out._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Union":
        node = node.children().apply(0)
    assert "Filter" in node.children().apply(1).toString()
    assert [int(r.reserved_quantity) for r in out.collect()] == [1]


def test_review_transition_rules(spark):
    req = spark.createDataFrame(
        [(1, 10, "Requested", None, None, None, None), (2, 20, "Approved", None, None, None, None),
         (3, 30, "Completed", None, None, None, None), (4, 40, "Requested", None, None, None, None)],
        "request_id long, session_id long, status string, completed_at timestamp, admin_note string, "
        "reviewed_by string, reviewed_at timestamp")
    dec = spark.createDataFrame([(1, "Completed", "n1", "adm"), (2, "Completed", "n2", "adm"),
                                 (3, "Rejected", "n3", "adm"), (4, "Bogus", "n4", "adm"), (9, "Approved", "n9", "adm")],
                                "request_id long, status string, admin_note string, reviewed_by string")
    at = F.lit(dt.datetime(2024, 2, 1))
    out = changes.review_transitions(req, dec, reviewed_at=at)
    st = {r.request_id: r for r in out["state"].collect()}
    rej = {r.request_id: r.reason for r in out["rejected"].collect()}
    assert st[1].status == "Requested" and "must be Approved" in rej[1]
    assert st[2].status == "Completed" and st[2].completed_at == dt.datetime(2024, 2, 1) and st[2].admin_note == "n2"
    assert st[3].status == "Completed" and rej[3] == "Reset request is already terminal (Completed)."
    assert rej[4] == "Unsupported reset-request status." and rej[9] == "Reset request not found."
    assert {(r.session_id, r.status) for r in out["sessions"].collect()} == {(20, "Reset Complete")}


def test_apply_changes_rules(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, created string")
    ch = spark.createDataFrame([
        (1, "update", 1, {"name": "A1"}), (2, "update", 1, {"name": "A2"}),      # both apply, in order
        (3, "update", 2, {"created": "z", "id": "9"}),                             # nothing editable
        (4, "delete", 5, {}), (5, "insert", 2, {"name": "dup"}), (6, "insert", 3, {"name": "c"}),
        (7, "delete", None, {})], "change_id long, op string, id long, values map<string,string>")
    out = changes.apply_changes(table, ch, ["id"], ["name"])
    audit = {r.change_id: (r.status, r.reason) for r in out["audit"].collect()}
    assert audit[1] == audit[2] == ("applied", None)
    assert audit[3] == ("rejected", "No editable column changes were supplied.")
    assert audit[4] == ("rejected", "Expected one row; affected 0.")
    assert audit[5] == ("rejected", "Row already exists.") and audit[6] == ("applied", None)
    assert audit[7] == ("rejected", "Complete primary key values are required.")
    assert _sorted(out["state"]) == [(1, "A2", "x"), (2, "b", "y"), (3, "c", None)]


def test_check_constraints_null_semantics(spark):
    lots = spark.createDataFrame([("L1",), ("L2",)], "lot_id string")
    w = spark.createDataFrame([(1, "r1", "L1", "ready", None, Decimal("1.0000")),
                               (2, "r1", None, None, False, Decimal("-1.0000")),
                               (3, None, "L9", "weighed", False, None),
                               (4, None, "L2", "weighed", None, Decimal("2.0000"))],
                              "id long, reservation_id string, lot_id string, status string, tare boolean, "
                              "qty decimal(18,4)")
    out = changes.check_constraints(
        w, "id", not_null=["status"], enums={"status": ["ready", "weighed"]}, non_negative=["qty"],
        unique=[["reservation_id"]], foreign={"lot_id": (lots, "lot_id")},
        rules={"tare_rule": F.col("status").isin("ready") | F.col("tare")})
    got = sorted((r.constraint_name, r.row_key) for r in out.collect())
    assert got == [("lot_id_fkey", "3"), ("qty_non_negative", "2"), ("reservation_id_unique", "1"),
                   ("reservation_id_unique", "2"), ("status_not_null", "2"), ("tare_rule", "3")]
    # NULL status passes the enum CHECK, NULL lot passes the FK, row 4's NULL tare makes the rule NULL -> passes


def test_running_total_chunked_equals_window(spark):
    from pyspark.sql import Window
    base = dt.datetime(2024, 1, 1)
    rows = [("hot", base + dt.timedelta(hours=7 * i), f"l{i:04d}", Decimal(i % 5 + 1)) for i in range(300)]
    rows += [("cold", base + dt.timedelta(hours=3), "c1", Decimal(2)), ("cold", base + dt.timedelta(hours=3), "c0", Decimal(4))]
    df = spark.createDataFrame(rows, "lot string, ts timestamp, id string, q decimal(18,4)")
    got = {r.id: r.running_total for r in ledger.running_total(df, "lot", "ts", "id", "q").collect()}
    w = Window.partitionBy("lot").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.id: r.rt for r in df.withColumn("rt", F.sum("q").over(w)).collect()}
    assert got == want and got["c1"] == Decimal(6)


def test_upsert_refuses_duplicate_source_keys(spark):
    import pytest
    t = spark.createDataFrame([(1, "a")], "k long, v string")
    s = spark.createDataFrame([(2, "x"), (2, "y")], "k long, v string")
    with pytest.raises(ValueError):
        changes.upsert(t, s, "k", check_unique=True)


def test_apply_changes_folds_columns_and_rejects_unreadable_values(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, name string, qty int")
    ch = spark.createDataFrame([
        (1, "update", 1, {"name": "A"}), (2, "update", 1, {"qty": "7"}),         # different columns: both stay
        (3, "update", 2, {"qty": "abc"}),                                          # not an int
        (4, "delete", 2, {}), (5, "update", 2, {"name": "gone"}), (6, "insert", 2, {"name": "new"}),
        (7, "update", 2, {"qty": "9"}), (8, "insert", 2, {"name": "again"}), (9, "insert", 4, {}),
    ], "change_id long, op string, id long, values map<string,string>")
    out = changes.apply_changes(table, ch, ["id"], ["name", "qty"])
    audit = {r.change_id: r.reason for r in out["audit"].collect()}
    assert audit == {1: None, 2: None, 3: "Invalid value for column 'qty'.", 4: None,
                     5: "Expected one row; affected 0.", 6: None, 7: None, 8: "Row already exists.",
                     9: "No insert values were supplied."}
    assert _sorted(out["state"]) == [(1, "A", 7), (2, "new", 9)]


def test_duplicate_and_null_source_keys(spark):
    t = spark.createDataFrame([(1, "a"), (None, "n")], "k long, v string")
    s = spark.createDataFrame([(1, "z"), (1, "y"), (None, "m"), (2, "b")], "k long, v string")
    once = changes.upsert(t, s, "k", check_unique=False)
    assert sorted(map(tuple, once.collect()), key=str) == [(1, "y"), (2, "b"), (None, "m")]
    assert sorted(map(tuple, changes.upsert(once, s, "k", check_unique=False).collect()), key=str) == \
        sorted(map(tuple, once.collect()), key=str)
    assert changes.insert_if_absent(once, s, "k").count() == 0
    assert changes.update_from(t, s, "k", ["v"]).count() == 2
    docs = spark.createDataFrame([("d", '{"a":1}')], "_id string, doc string")
    patches = spark.createDataFrame([("d", '{"b":2}'), ("d", '{"b":3}')], "_id string, patch string")
    assert [r.doc for r in changes.patch_documents(docs, patches).collect()] == ['{"a":1,"b":2}']
