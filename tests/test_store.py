"""Sinks that replace and export, the registry after a discovery, and paged groups."""

import glob
import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from keelson.operators import catalog, paging
from keelson.session import scratch_path
from keelson.sources import sinks


def test_failed_replace_leaves_the_old_table(spark):
    path = scratch_path(spark, f"replace-{uuid.uuid4().hex}")
    sinks.write_table(spark.range(3).toDF("x"), path)
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_table(broken, path, "replace")
    assert spark.read.parquet(path).count() == 3
    sinks.write_table(spark.read.parquet(path).where("x > 0"), path, "replace")         # it may read what it replaces
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 2]


def test_export_of_nothing_has_a_header(spark):
    d = tempfile.mkdtemp(prefix="keelson-export-")
    sinks.export_csv(spark.createDataFrame([], 'a long, `b "c"` string'), d + "/empty")
    assert [open(f).read() for f in glob.glob(d + "/empty/part-*")] == ['"a","b ""c"""\n']
    df = spark.createDataFrame([(1, "x\ny"), (2, None), (3, "")], "a long, b string")
    sinks.export_csv(df.repartition(3), d + "/many")
    parts = [open(f).read() for f in glob.glob(d + "/many/part-*") if os.path.getsize(f)]
    assert all(p.startswith('"a","b"\n') for p in parts) and sum(p.count('"a","b"') for p in parts) == len(parts)


def test_store_ordered_by_system_skips_files(spark):
    path = scratch_path(spark, f"store-{uuid.uuid4().hex}")
    n = 40_000
    ev = spark.range(n).select(F.lit("c").alias("collection"), F.format_string("sys-%03d", F.col("id") * 7919 % 100).alias("system_key"),
                               F.timestamp_seconds(F.col("id") * 1009 % n).alias("timestamp"), "id")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.event_store(ev.repartition(16), path, max_records_per_file=1000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    back = spark.read.parquet(path).select("system_key", F.col("_metadata.file_path").alias("file"))
    files = back.groupBy("file").agg(F.min("system_key").alias("low"), F.max("system_key").alias("high")).collect()
    read = [f for f in files if f.low <= "sys-042" <= f.high]
    assert len(files) >= 40 and len(read) <= 0.1 * len(files) and back.where("system_key = 'sys-042'").count() == n // 100


def test_registry_after_discoveries(spark):
    cols = "system_id long, dataset_key string, dataset_name string, description string, is_active boolean"
    old = spark.createDataFrame([(1, "a", "A", "kept", True), (1, "b", "B", None, True), (1, "c", "C", None, False), (None, "d", "D", None, True)], cols)
    found = spark.createDataFrame([(1, "a", "A2"), (1, "c", "C"), (None, "d", "D"), (2, "a", "new"), (2, "a", "new")],
                                  "system_id long, dataset_key string, dataset_name string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    new = catalog.next_registry(found, old)
    assert rows(new) == sorted([(1, "a", "A2", "kept", True, "updated"), (1, "b", "B", None, True, "unchanged"),
                                (1, "c", "C", None, True, "updated"), (None, "d", "D", None, True, "unchanged"),
                                (2, "a", "new", None, True, "created")], key=str)
    again = catalog.next_registry(found, new.drop("action"))
    assert {r.action for r in again.collect()} == {"unchanged"} and rows(again.drop("action")) == rows(new.drop("action"))
    left = catalog.next_registry(found, old, update_existing=False)
    assert sorted(r.action for r in left.collect()) == ["created", "skipped", "skipped", "skipped", "unchanged"]
    assert rows(left.where("action <> 'created'").drop("action")) == rows(old)


def test_a_key_with_a_million_matches(spark):
    n = 1_000_000
    inner = spark.range(n).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % n).alias("v")).union(
        spark.createDataFrame([("cold", 2), ("cold", 1), (None, 5)], "k string, v long"))
    outer = spark.createDataFrame([("hot",), ("cold",), ("none",)], "k string")
    out = paging.lookup_pages(outer, inner, "k", ["v"], F.col("v"), "vs", 10_000).cache()
    hot = out.where("k = 'hot'").select("page", "n", F.size("vs").alias("s"), F.array_min("vs").alias("low"), F.array_max("vs").alias("high"),
                                        (F.sort_array("vs") == F.col("vs")).alias("sorted")).orderBy("page").collect()
    assert [(r.page, r.n, r.s, r.low, r.high, r.sorted) for r in hot] == \
        [(i + 1, 10_000, 10_000, 10_000 * i, 10_000 * i + 9_999, True) for i in range(100)]
    assert sorted((r.k, r.page, r.n, r.vs) for r in out.where("k <> 'hot'").collect()) == [("cold", 1, 2, [1, 2]), ("none", 1, 0, [])]
    out.unpersist()


def test_only_new_folders_are_profiled(spark):
    from keelson.operators import profile
    base, store = tempfile.mkdtemp(prefix="keelson-folders-"), tempfile.mkdtemp(prefix="keelson-profile-")
    folders = {}
    for k in range(3):
        folders[f"d{k}"] = f"{base}/d{k}"
        df = spark.range(1000 * k, 1000 * k + 1000).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 7).alias("v"),
                                                           F.when(F.col("id") % 2 == 0, "x").otherwise("").alias("s"), F.lit(None).cast("int").alias("z"))
        df.write.parquet(folders[f"d{k}"])
    assert profile.refresh(spark, {k: folders[k] for k in ("d0", "d1")}, store) == ["d0", "d1"]
    folders["d0"] = f"{base}/nowhere"                           # a refresh that read it again would fail
    assert profile.refresh(spark, folders, store) == ["d2"] and profile.refresh(spark, folders, store) == []
    p = {r.column_name: r for r in profile.merged_profile(spark, store).collect()}
    assert (p["id"].row_count, p["id"].non_null, p["id"].low, p["id"].high) == (3000, 3000, 0.0, 2999.0)
    assert abs(p["id"].distinct_values - 3000) < 90 and abs(p["id"].median - 1500) < 60
    assert (p["v"].non_null, p["v"].distinct_values, p["z"].non_null, p["z"].distinct_values, p["z"].median) == (2250, 7, 0, 0, None)
    assert sorted((f["item"], f["count"]) for f in p["s"].frequent) == [("", 1500), ("x", 1500)]
    assert p["s"].distinct_values == 2 and p["s"].median is None
