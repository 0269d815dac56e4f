"""Properties from the reference's own checks, on the driver tables (sf0.001)."""

from pyspark.sql import functions as F

from keelson.operators import baseline, ledger
from keelson.plans.registry import load_all
from keelson.plans.roles import Roles

from .conftest import SF_SMALL

Q, _ = load_all()


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_restore_is_idempotent(spark):
    r = Roles(spark, SF_SMALL)
    snap = baseline.snapshot(r.material_lots, r.material_catalog, ("available", "released", "reserved"))
    once = baseline.restore(r.live_lots, snap)
    twice = baseline.restore(once.drop("mirror_status"), snap)
    assert _rows(once) == _rows(twice)
    # after a restore, nothing the baseline holds differs (status remap aside)
    remapped = snap.withColumn("status", F.when(F.col("status") == "released", "available").otherwise(F.col("status")))
    m = baseline.mismatch_count(once, remapped, "internal_lot_number",
                                ["available_quantity", "reserved_quantity", "status"], "inner").first()
    assert m.mismatches == 0 and m.compared > 0


def test_balance_conservation(spark):
    df = Q["lot_balances"](spark, SF_SMALL)
    rows = df.collect()
    assert rows
    for x in rows:
        rest = x.received_quantity - x.issued_quantity - x.reserved_quantity
        if rest >= 0:
            assert abs(x.available_quantity + x.reserved_quantity + x.issued_quantity - x.received_quantity) < 1e-9
        else:
            assert x.available_quantity == 0 and x.status == "depleted"


def test_typed_load_accounts_for_every_row(spark):
    read = spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()
    acc = Q["typed_load_accepted"](spark, SF_SMALL).count()
    rej = Q["typed_load_rejected"](spark, SF_SMALL).count()
    assert acc + rej == read and rej > 0


def test_issue_once(spark):
    r = Roles(spark, SF_SMALL)
    to_issue = (r.material_reservations.where(F.col("status") == "reserved")
                .select("reservation_id", "material_lot_id", "reserved_quantity"))
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    first = ledger.post_issue(to_issue, r.material_issues.select("reservation_id"), r.material_lots, at)
    issued = r.material_issues.select("reservation_id").unionByName(first["issues"].select("reservation_id"))
    again = ledger.post_issue(to_issue, issued, r.material_lots, at)
    assert first["issues"].count() > 0 and again["issues"].count() == 0


def test_sync_state_is_idempotent(spark):
    from keelson.plans.ledger_plans import _sync_inputs
    state, processed = _sync_inputs(Roles(spark, SF_SMALL))
    once = ledger.sync_state(state, processed)
    assert _rows(ledger.sync_state(once, processed)) == _rows(once)


def test_rebuild_staged(spark):
    live = spark.createDataFrame([("c1", "A", 1.0), ("c2", "B", 2.0), ("c3", None, 3.0)],
                                 "container_id string, hazard string, qty double")
    base = spark.createDataFrame([("c1", "A", 9.0), ("c4", "A", 4.0)], "container_id string, hazard string, qty double")
    out = baseline.rebuild_staged(live, base, F.col("hazard") == "A")
    assert _rows(out) == [("c1", "A", 9.0), ("c2", "B", 2.0), ("c3", None, 3.0), ("c4", "A", 4.0)]


def test_binding_ids_are_primary_keys(spark):
    from keelson.operators.changes import duplicate_keys
    r = Roles(spark, SF_SMALL)
    for role, key in [("process_runs", "process_run_id"), ("deviations", "deviation_id"),
                      ("quality_results", "quality_result_id"), ("material_lots", "material_lot_id"),
                      ("batches", "batch_id")]:
        assert duplicate_keys(r[role], key).count() == 0, role


def test_unique_ids_mode_equals_exact_mode(spark):
    from keelson.operators import kpi
    r = Roles(spark, SF_SMALL)
    args = (r.batches, r.production_orders, r.products, r.process_runs, r.deviations, r.quality_results)
    assert _rows(kpi.batch_kpis(*args, unique_ids=True)) == _rows(kpi.batch_kpis(*args))


def test_recipe_expand_takes_every_order_of_the_customer_and_skips_what_a_batch_has(spark, tmp_path):
    from keelson.plans.change_plans import q_recipe_expand
    from keelson.plans.roles import Roles
    ts = "timestamp_ntz'1995-01-01 00:00:00'"
    spark.sql(f"SELECT * FROM VALUES (10L, 7L, 'F', 1D, {ts}, '2-HIGH'), (11L, 7L, 'O', 1D, {ts}, '2-HIGH') "
              "AS t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT l_orderkey, l_partkey, 1L AS l_suppkey, l_linenumber, l_quantity, 0D AS l_discount, 0D AS l_tax, "
              f"'A' AS l_returnflag, 'F' AS l_linestatus, {ts} AS l_shipdate FROM VALUES (10L, 1L, 1, 5D), (11L, 2L, 1, 6D), "
              "(11L, 1L, 2, 4D), (99L, 3L, 1, 9D) AS t(l_orderkey, l_partkey, l_linenumber, l_quantity)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS p_partkey, 'n' AS p_name, 'b' AS p_brand, 't' AS p_type, 1 AS p_size, 1D AS p_retailprice "
              "FROM range(1, 4)").write.parquet(f"{tmp_path}/part.parquet")
    got = q_recipe_expand(Roles(spark, str(tmp_path))).collect()
    # Batch 11 has both materials; batch 10 gets what the customer's second order asked for.
    assert [(r.batch_id, r.material_id, float(r.required_quantity)) for r in got] == [(10, 2, 6.0)]
