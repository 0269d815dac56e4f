"""Sinks (L6, L10-L13), chart helpers (G1-G5, W3) and catalog upkeep (K3-K9) on small frames."""

import glob
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from keelson.operators import catalog, charts, selection
from keelson.sources import sinks


def _tmp():
    return tempfile.mkdtemp(prefix="keelson-sink-")


def test_write_table_modes(spark):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    p = _tmp() + "/t"
    with pytest.raises(FileNotFoundError):
        sinks.write_table(df, p, "append")
    sinks.write_table(df, p, "create")
    with pytest.raises(FileExistsError):
        sinks.write_table(df, p, "create")
    sinks.write_table(df, p, "append")
    assert spark.read.parquet(p).count() == 2
    sinks.write_table(df, p, "replace")
    assert spark.read.parquet(p).count() == 1


def test_export_csv_keeps_null_and_empty_apart(spark):
    df = spark.createDataFrame([(1, None, 'say "hi"'), (2, "", "x,y")], "id long, a string, b string")
    p = _tmp() + "/out"
    sinks.export_csv(df.repartition(2), p)
    files = [open(f).read().strip().split("\n") for f in sorted(glob.glob(p + "/part-*"))]
    files = [f for f in files if f != [""]]
    assert files and all(f[0] == '"id","a","b"' for f in files)  # every file carries the header
    assert sorted(line for f in files for line in f[1:]) == ['"1",,"say ""hi"""', '"2","","x,y"']
    one = _tmp() + "/one"
    sinks.export_csv(df, one, single_file=True)
    parts = [f for f in glob.glob(one + "/part-*") if open(f).read().strip()]
    assert len(parts) == 1


def test_export_json_writes_nulls(spark):
    df = spark.createDataFrame([(1, None)], "id long, a string")
    p = _tmp() + "/j"
    sinks.export_json(df, p)
    rec = [json.loads(line) for f in glob.glob(p + "/part-*") for line in open(f) if line.strip()]
    assert rec == [{"id": 1, "a": None}]


def test_event_sink_layout_and_freeze(spark):
    ev = spark.createDataFrame(
        [("e1", "telemetry_events", "s1", "2024-01-01 10:00:00", None), ("e2", "alert_events", "s2", "2024-01-02 11:00:00", None),
         ("e3", "alert_events", "s2", "2024-01-02 12:00:00", "bad")],
        "event_id string, collection string, system_key string, timestamp string, reject_reason string") \
        .withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    p = _tmp() + "/ev"
    sinks.event_sink(ev, p)
    dirs = sorted(os.path.relpath(d, p) for d in glob.glob(p + "/collection=*/event_date=*"))
    assert dirs == ["collection=alert_events/event_date=2024-01-02", "collection=telemetry_events/event_date=2024-01-01"]
    assert spark.read.parquet(p).count() == 2  # the rejected event is not stored
    fz = _tmp() + "/fz"
    sinks.freeze_rows(ev, [F.col("event_id")], fz, {"chart_name": "c1"}, limit=2)
    assert [r.event_id for r in spark.read.parquet(fz).orderBy("event_id").collect()] == ["e1", "e2"]


def test_chart_points_scale_pie(spark):
    rows = [(1, "a", "3"), (2, None, "x"), (3, "c", "-1"), (4, None, "Infinity"), (5, "e", " 2 ")]
    df = spark.createDataFrame(rows, "o long, x string, y string")
    pts = charts.chart_points(df, "x", "y", [F.col("o")])
    got = [(r.position, r.label, r.value) for r in pts.orderBy("position").collect()]
    assert got == [(1, "a", 3.0), (3, "c", -1.0), (5, "e", 2.0)]
    sc = {r.position: r for r in charts.chart_scale(pts).collect()}
    assert (sc[1].min_value, sc[1].max_value, sc[1].span) == (-1.0, 3.0, 4.0)
    pie = {r.position: r for r in charts.pie_shares(pts).collect()}
    assert set(pie) == {1, 5} and pie[1].fraction == 0.6 and pie[5].offset == 0.6
    flat = spark.createDataFrame([(1, "a", "0")], "o long, x string, y string")
    assert charts.chart_scale(charts.chart_points(flat, "x", "y", [F.col("o")])).first().span == 1.0


def test_first_numeric_key_and_dashboard(spark):
    df = spark.createDataFrame([("a", None, "1.5"), ("b", "x", None)], "label string, note string, v string")
    assert selection.first_numeric_key(df).first()[0] == "v"
    ch = spark.createDataFrame([("c1", "D", "alerts", None, 10), ("c2", "D", "alerts", "s1", 5),
                                ("c3", "D", "logs", "s1", 7), ("c4", "E", "logs", None, 1)],
                               "chart_id string, dashboard_name string, collection string, system_key string, data_points long")
    all_ = charts.dashboard_summary(ch, "D").first()
    assert (all_.charts, all_.collections, all_.systems, all_.data_points) == (3, 2, 2, 22)
    un = charts.dashboard_summary(ch, "D", "Unassigned").first()
    assert (un.charts, un.data_points) == (1, 10)


def test_catalog_upkeep(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "k long, v string")
    prof = {r.column_name: r for r in catalog.profile_table(t, "t", exact_distinct=True).collect()}
    assert (prof["k"].non_null, prof["k"].distinct_values, prof["v"].non_null, prof["v"].row_count) == (3, 2, 2, 3)
    disc = spark.createDataFrame([(1, "x"), (1, "y")], "system_id long, dataset_key string")
    reg = spark.createDataFrame([(1, "x")], "system_id long, dataset_key string")
    act = {r.dataset_key: r.action for r in catalog.register_datasets(disc, reg, update_existing=False).collect()}
    assert act == {"x": "skipped", "y": "created"}
    rels = spark.createDataFrame([("r1", "a", "b", "feeds")],
                                 "relationship_id string, source_dataset_id string, target_dataset_id string, relationship_type string")
    cand = spark.createDataFrame([("n1", "a", "b", "feeds"), ("n2", "a", "a", "feeds"), ("n3", "b", "c", "feeds")],
                                 "relationship_id string, source_dataset_id string, target_dataset_id string, relationship_type string")
    assert [r.relationship_id for r in catalog.add_relationship(rels, cand).collect()] == ["n3"]


def test_append_needs_existing_columns(spark):
    p = _tmp() + "/t2"
    sinks.write_table(spark.createDataFrame([(1,)], "k long"), p, "create")
    with pytest.raises(ValueError):
        sinks.write_table(spark.createDataFrame([(1, "x")], "k long, extra string"), p, "append")
