"""Plan-shape guards for every registered query (planned at sf0.001, not executed)."""

import pytest

from keelson.plans.registry import load_all

from .conftest import SF_SMALL

QUERIES, _ = load_all()
# Queries that cross-join a one-row aggregate (or a bounded page / chart) by design.
ONE_ROW_CROSS = {"baseline_status", "before_after", "chart_scale", "paginate", "pie_shares", "registry_overview",
                 "session_overview", "verify_counts"}
# Queries that run the E4 key walk (the one Arrow-batched Python UDF).
ARROW_PYTHON = {"validate_keys", "ingest_batch", "events_per_system", "ingest_stream"}
# Queries that execute a stream or write a file while being built.
EAGER = {"csv_source", "windowed_rollup_stream", "session_rollup_stream", "dedupe_events_stream",
         "grid_snapshot_stream", "ingest_stream", "ledger_cycle"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_plan_shape(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python UDF
    if name not in ONE_ROW_CROSS:
        assert "BroadcastNestedLoopJoin" not in plan, name
    if name not in ARROW_PYTHON:
        assert "ArrowEvalPython" not in plan, name


def test_role_filters_reach_the_scan(spark):
    plan = QUERIES["deviation_summary"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint" in plan


@pytest.mark.parametrize("name", ["fefo_lot_choice", "lateral_top1", "dedupe_events", "recipe_expand"])
def test_top1_is_a_partial_aggregate_not_a_window(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan  # reduced map-side, before any shuffle
    assert "Window" not in plan


@pytest.mark.parametrize("name", ["batch_kpis", "batch_process_summary"])
def test_distinct_counts_without_expand(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "count(distinct" not in plan.lower()


def test_row_counts_scan_each_source_once(spark):
    plan = QUERIES["row_counts"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 5  # part, customer, orders, lineitem, supplier


def _joins_of_the_first_input(df):
    node, kinds = df._jdf.queryExecution().optimizedPlan(), []
    while node.children().size():
        if node.nodeName() == "Join":
            kinds.append(node.joinType().toString())
        node = node.children().apply(0)
    return kinds


def test_traceability_joins_wide_rows_by_own_id_batch_and_material_only(spark):
    # material, batch with its order, then issue, weighing and request lines by the material's own id
    assert _joins_of_the_first_input(QUERIES["traceability"](spark, SF_SMALL)) == ["Inner", "Inner"] + ["LeftOuter"] * 3


def test_the_librarys_own_session_compresses_shuffles_with_zstd(spark):
    assert spark.sparkContext.getConf().get("spark.io.compression.codec") == "zstd"     # 40% fewer bytes than lz4 for wide rows


def test_request_lines_drop_existing_ones_before_the_other_joins(spark):
    assert _joins_of_the_first_input(QUERIES["derive_request_lines"](spark, SF_SMALL)) == ["Inner", "Inner", "LeftAnti"]


def test_exact_dashboard_deals_batches_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")        # as where no side is small
    try:
        df = QUERIES["production_dashboard_exact"](spark, SF_SMALL)
        plan = df._jdf.queryExecution().executedPlan().toString()
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("LeftSemi") == 1                                  # steps; no table is read to test that batches exist
    assert plan.count("hashpartitioning(batch_id") == 5                 # ids, counts, roll-ups, CPP by batch and step, the batches
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, QUERIES["production_dashboard"](spark, SF_SMALL).collect()), key=str)
