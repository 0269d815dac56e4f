"""Restore of all tables, publication as one step, and the change operators on odd keys."""

import uuid

import pytest
from pyspark.sql import functions as F

from keelson.operators import baseline, changes, restore
from keelson.session import scratch_path
from keelson.sources.publish import AuditFailed, publish, published, same_rows, versions

LOT = "internal_lot_number string, available_quantity int, reserved_quantity int, status string"


def tables(spark):
    live = {
        "lots": spark.createDataFrame([("L1", 9, 9, "x"), ("L2", 9, 9, "blocked"), ("L3", 9, 9, "x")], LOT),
        "mirror": spark.createDataFrame([("L1", 0, 0, "?"), ("L4", 1, 1, "kept")], "lot_number string, quantity int, reserved_quantity int, qa_status string"),
        "staged": spark.createDataFrame([("C1", "M", "L1", 1, "CW-STAGE-01", "Moved", None, "P"), ("C2", "M", "L1", 1, None, "Moved", None, "P")],
                                        "container_id string, material_code string, lot_number string, quantity int, location_code string, "
                                        "status string, hazard_class string, po_number string"),
        "tanks": spark.createDataFrame([("T1", 1, "q", None, 20, "idle"), ("T2", 1, "q", None, 20, "idle")],
                                       "tank_code string, quantity_kg int, qa_status string, lot_number string, temperature_c int, status string")}
    saved = {
        "lots": spark.createDataFrame([("a", "L1", 5, 1, "RELEASED"), ("a", "L1", 4, 1, "Released"), ("b", "L2", 1, 1, "x"),
                                       ("a", "L3", 7, 0, "on HOLD"), ("a", None, 1, 1, "x")], "snapshot_id string, " + LOT),
        "staged": spark.createDataFrame([("a", "C9", "M", "L9", 3, "CW-HAZ-01", "acid"), ("b", "C8", "M", "L9", 3, "CW-HAZ-01", "acid")],
                                        "snapshot_id string, container_id string, material_code string, lot_number string, quantity int, "
                                        "location_code string, hazard_class string"),
        "tanks": spark.createDataFrame([("a", "T1", 50, "ok", "L1", 4, "in use")],
                                       "snapshot_id string, tank_code string, quantity_kg int, qa_status string, lot_number string, "
                                       "temperature_c int, status string")}
    return live, saved


def test_restore_publishes_all_tables_together(spark):
    live, saved = tables(spark)
    root = scratch_path(spark, f"restore-{uuid.uuid4().hex}")
    assert restore.restore_and_publish(live, saved, "a", root) == 1
    now = {n: published(spark, root, n) for n in live}
    rows = lambda n: sorted(map(tuple, now[n].collect()), key=str)
    assert rows("lots") == [("L1", 4, 1, "available"), ("L2", 9, 9, "blocked"), ("L3", 7, 0, "on HOLD")]
    assert rows("mirror") == [("L1", 4, 1, "Released"), ("L4", 1, 1, "kept")]
    assert rows("staged") == [("C2", "M", "L1", 1, None, "Moved", None, "P"), ("C9", "M", "L9", 3, "CW-HAZ-01", "Staged", "acid", None)]
    assert rows("tanks") == [("T1", 50, "ok", "L1", 4, "in use"), ("T2", 1, "q", None, 20, "idle")]
    assert {r.mismatches for r in restore.compared(now, saved, "a").collect()} == {0}
    assert {r.table_name: r.mismatches for r in restore.compared(live, saved, "a").collect()} == \
        {"lots": 2, "mirror": 1, "staged": 2, "tanks": 1}
    again = restore.restored_states(now, saved, "a")                    # applying it twice changes nothing
    assert all(sorted(map(tuple, again[n].collect()), key=str) == rows(n) for n in live)


def test_restore_reduces_the_snapshot_once(spark, monkeypatch):
    live, saved = tables(spark)
    got, real = [], restore.of_snapshot
    monkeypatch.setattr(restore, "of_snapshot", lambda rows, snapshot, key: (got.append(key), real(rows, snapshot, key))[1])
    root = scratch_path(spark, f"restore-{uuid.uuid4().hex}")
    rows = restore.stored_snapshot(saved, "a")
    assert restore.restore_and_publish(live, saved, "a", root, rows) == 1
    now = {n: published(spark, root, n) for n in live}
    found = {r.table_name: (r.compared, r.mismatches) for r in restore.compared(now, saved, "a", rows=rows).collect()}
    assert found == {"lots": (2, 0), "mirror": (1, 0), "staged": (2, 0), "tanks": (1, 0)}
    assert sorted(got) == ["internal_lot_number", "tank_code"]          # new states, audit and report read the stored rows
    assert sorted(map(tuple, rows["lots"].collect())) == [("L1", 4, 1, "Released"), ("L3", 7, 0, "on HOLD")]
    assert restore.restore_and_publish(live, saved, "a", root) == 2 and len(got) == 4


def test_failed_publication_leaves_the_old_tables(spark):
    root = scratch_path(spark, f"publish-{uuid.uuid4().hex}")
    with pytest.raises(FileNotFoundError):
        published(spark, root, "t")
    assert publish({"t": spark.range(3).toDF("x"), "u": spark.range(1).toDF("x")}, root) == 1
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        publish({"u": spark.range(9).toDF("x"), "t": broken}, root)
    with pytest.raises(AuditFailed, match="negative"):
        publish({"t": spark.range(9).toDF("x")}, root, {"negative": lambda w: w["t"].where("x > 7")})
    assert versions(spark, root) == [1] and published(spark, root, "t").count() == 3 and published(spark, root, "u").count() == 1
    new = spark.createDataFrame([(1,), (1,), (None,)], "x long")
    assert publish({"t": new}, root, {"whole": same_rows("t", new)}) == 2
    assert published(spark, root, "t").count() == 3 and published(spark, root, "t", 1).where("x is null").count() == 0
    with pytest.raises(AuditFailed):
        publish({"t": new}, root, {"whole": same_rows("t", new.limit(2))})


def test_decisions_apply_in_order(spark):
    req = spark.createDataFrame([(1, 10, "Requested"), (2, 20, "Completed"), (3, 30, "Approved")], "request_id int, session_id int, status string") \
        .selectExpr("*", "cast(null as timestamp) completed_at", "cast(null as string) admin_note", "cast(null as string) reviewed_by",
                    "cast(null as timestamp) reviewed_at")
    dec = spark.createDataFrame([(1, 1, "Completed"), (1, 2, "Approved"), (1, 3, "Completed"), (1, 4, "Rejected"), (1, 5, "Completed"),
                                 (2, 1, "Completed"), (2, 2, "Approved"), (3, 1, "Odd"), (3, 2, "Rejected"), (3, 3, "Rejected"), (9, 1, "Approved")],
                                "request_id int, n int, status string").selectExpr("*", "concat('n', n) admin_note", "'me' reviewed_by")
    out = changes.review_transitions(req, dec, order=["n"])
    assert sorted((r.request_id, r.status, r.admin_note, r.completed_at is not None) for r in out["state"].collect()) == \
        [(1, "Completed", "n3", True), (2, "Completed", None, False), (3, "Rejected", "n3", True)]
    assert sorted((r.request_id, r.status) for r in out["rejected"].collect()) == \
        [(1, "Completed"), (1, "Completed"), (1, "Rejected"), (2, "Approved"), (2, "Completed"), (3, "Odd"), (9, "Approved")]
    assert sorted((r.session_id, r.status) for r in out["sessions"].collect()) == \
        [(10, "Reset Approved"), (10, "Reset Complete"), (30, "Reset Rejected"), (30, "Reset Rejected")]


def test_children_without_a_parent_are_replaced(spark):
    old = spark.createDataFrame([(None, "a"), (1, "b"), (2, "c")], "parent int, x string")
    new = spark.createDataFrame([(None, "d"), (2, "e")], "parent int, x string")
    once = changes.replace_children(old, new, "parent")
    twice = changes.replace_children(once, new, "parent")
    assert sorted(r.x for r in once.collect()) == sorted(r.x for r in twice.collect()) == ["b", "d", "e"]


def test_single_table_restore_reads_any_case_and_one_row_per_key(spark):
    live = spark.createDataFrame([("L1", 1, 1, "x")], LOT)
    base = spark.createDataFrame([("L1", 3, 0, "Released"), ("L1", 2, 0, "RELEASED")], LOT)
    (row,) = baseline.restore(live, base).collect()
    assert (row.available_quantity, row.status, row.mirror_status) == (2, "available", "Released")
    one = changes.one_per_key(base, "internal_lot_number")
    cols = ["available_quantity", "status"]
    restored = baseline.restore(live, base).drop("mirror_status")
    assert baseline.mismatch_count(restored, one, "internal_lot_number", cols).first().mismatches == 1
    assert baseline.mismatch_count(restored, one, "internal_lot_number", cols, remap={"status": restore.lot_status()}).first().mismatches == 0


def test_constraints_in_one_scan(spark):
    rows = [(1, "a", "x", 1.5, 5), (2, "a", "x", None, 6), (3, "a|b", "c", -1.0, None), (4, "a", "b|c", 2.0, 9), (5, None, "x", 0.0, 5), (6, None, None, 0.0, 5)]
    df = spark.createDataFrame(rows, "id int, a string, b string, q double, parent int")
    parents = spark.createDataFrame([(5,), (5,), (6,), (None,)], "p long")
    got = changes.check_constraints(df, "id", not_null=["q"], enums={"a": ["a"]}, non_negative=["q"], unique=[["a", "b"], ["q"]],
                                    foreign={"parent": (parents, "p")}, rules={"small": F.col("q") < 2})
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        ("q_not_null", "2", None), ("a_check", "3", "a|b"), ("q_non_negative", "3", "-1.0"), ("small", "4", None),
        ("a_b_unique", "1", "a|x"), ("a_b_unique", "2", "a|x"), ("q_unique", "5", "0.0"), ("q_unique", "6", "0.0"),
        ("parent_fkey", "4", "9")], key=str)
    assert changes.check_constraints(df.limit(0), "id", unique=[["a"]], foreign={"parent": (parents, "p")}).count() == 0
    assert changes.check_constraints(df, "id", not_null=["q"]).count() == 1
