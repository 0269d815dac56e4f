"""Structured Streaming forms give the batch answers."""

import tempfile

from pyspark.sql import functions as F

from keelson.operators import events as E
from keelson.streaming import events as S

from .conftest import SF_SMALL


def run_to_memory(df, name, mode="append"):
    """Drive a stream over its available input into the memory sink."""
    import uuid
    name = f"{name}_{uuid.uuid4().hex}"
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", tempfile.mkdtemp(prefix="keelson-mem-")).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)


def _stream_dir(spark):
    d = tempfile.mkdtemp(prefix="keelson-stream-")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.repartition(4, "user_id").write.mode("overwrite").parquet(f"{d}/events")
    return d, ev


def test_windowed_rollup_stream_equals_batch(spark):
    d, ev = _stream_dir(spark)
    src = S.read_stream(spark, f"{d}/events", ev.schema)
    # Complete mode with a watermark wider than the data: every window is final
    # (append mode emits a window only after the watermark passes its end).
    got = run_to_memory(S.windowed_rollup_stream(src, watermark="40 days"), "wr_stream", mode="complete")
    want = E.windowed_rollup(ev, "ts", ["event_type"], "value", "1 hour")
    key = ["window_start", "event_type", "events", "value_sum"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_ingest_stream_equals_batch(spark):
    from keelson.plans.roles import Roles
    r = Roles(spark, SF_SMALL)
    raw = r.ingest_events
    d = tempfile.mkdtemp(prefix="keelson-ingest-")
    raw.write.parquet(f"{d}/raw")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    src = S.read_stream(spark, f"{d}/raw", raw.schema, max_files=100)
    got = run_to_memory(S.ingest_stream(src, r.systems, now).select("source_event_id", "reject_reason"), "ing_stream")
    want = E.ingest(raw, r.systems, now).select("source_event_id", "reject_reason")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_dedupe_stream_drops_repeats(spark):
    d, ev = _stream_dir(spark)
    src = S.read_stream(spark, f"{d}/events", ev.schema)
    keys = ["user_id", "event_type"]
    got = run_to_memory(S.dedupe_stream(src, keys, watermark="40 days"), "dd_stream")     # four micro-batches
    want = E.dedupe_events(ev, keys, "ts", "event_id").select(*keys, F.window("ts", "1 hour").start.alias("w"))
    assert got.count() < ev.count()
    assert sorted(map(tuple, got.select(*keys, F.col("window_start")).collect())) == sorted(
        map(tuple, want.select(*keys, F.col("w").cast("timestamp_ntz")).collect()))


def test_whole_span_keeps_late_rows_over_several_batches(spark):
    from keelson.plans.stream_plans import whole_span
    d = tempfile.mkdtemp(prefix="keelson-late-")
    ev = spark.range(200).selectExpr(
        "id AS user_id", "timestamp_ntz'2024-01-01 00:10:00' + make_interval(0, 0, 0, CAST(id AS INT)) AS ts").coalesce(1)
    for part in ("user_id >= 150", "user_id BETWEEN 50 AND 149", "user_id < 50"):       # newest first, 200 days in all
        ev.where(part).write.mode("append").parquet(f"{d}/events")
    src = S.read_stream(spark, f"{d}/events", ev.schema, max_files=1)
    got = run_to_memory(S.dedupe_stream(src, ["user_id"], watermark=whole_span(ev, "ts")), "late_stream")
    assert sorted(r.user_id for r in got.collect()) == list(range(200))
    short = run_to_memory(S.dedupe_stream(src, ["user_id"], watermark="40 days"), "late_short")
    assert short.count() < 200
    assert whole_span(ev.limit(0), "ts") == "7200 seconds"


def test_route_to_collections_foreach_batch(spark):
    import glob
    import os
    from keelson.plans.roles import Roles
    r = Roles(spark, SF_SMALL)
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    out = tempfile.mkdtemp(prefix="keelson-route-") + "/events"
    ck = tempfile.mkdtemp(prefix="keelson-route-ck-")
    stream = S.ingest_stream(r.stream("ingest_events"), r.systems, now)
    q = (stream.writeStream.foreachBatch(S.route_to_collections(out)).option("checkpointLocation", ck)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    stored = spark.read.parquet(out)
    want = E.ingest(r.ingest_events, r.systems, now).where("reject_reason IS NULL").count()
    assert stored.count() == want > 0
    colls = {os.path.basename(p) for p in glob.glob(out + "/collection=*")}
    assert colls <= {f"collection={c}" for c in E.COLLECTION_BY_EVENT_TYPE.values()} and len(colls) >= 3


def test_append_mode_windows_are_final(spark):
    """Production path: append mode, short watermark -- every emitted window equals the batch value."""
    d = tempfile.mkdtemp(prefix="keelson-append-")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    # time-ordered files so the watermark advances file by file
    for i, (lo, hi) in enumerate([("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-21", "2024-02-01")]):
        ev.where(f"ts >= '{lo}' AND ts < '{hi}'").write.parquet(f"{d}/events/part{i}")
    src = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events/*")
    got = S.run_to_table(S.windowed_rollup_stream(src, "1 hour", "10 minutes"), "append_rollup", mode="append")
    want = {(r.window_start, r.event_type): (r.events, r.value_sum)
            for r in E.windowed_rollup(ev, "ts", ["event_type"], "value", "1 hour").collect()}
    rows = got.collect()
    assert rows and all(want[(r.window_start, r.event_type)] == (r.events, r.value_sum) for r in rows)


def _fed(spark, rows, transform, name):
    from keelson.streaming.batches import run_batches
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("minute") * 60).cast("timestamp_ntz")
    df = spark.createDataFrame(rows, "batch int, key string, minute long").withColumn("ts", at).withColumn("value", F.lit(1.0))
    out, held = run_batches(df, "batch", transform, name)
    minute = lambda t: int((t - __import__("datetime").datetime(2024, 1, 1)).total_seconds() // 60)
    return out, held, minute


def test_windows_leave_the_state_and_late_rows_are_dropped(spark):
    rows = [(0, k, m) for k in "abcdef" for m in (0, 70, 130)] + [(1, "a", 600), (2, "a", 20), (2, "b", 595), (3, "a", 2000)]
    out, held, minute = _fed(spark, rows, lambda s: E.windowed_rollup(s, "ts", ["key"], "value", "1 hour", watermark="30 minutes"), "w")
    got = sorted((r.key, minute(r.window_start), r.events) for r in out.collect())
    early = [(k, m, 1) for k in "abcdef" for m in (0, 60, 120)]
    assert got == sorted(early + [("a", 600, 1), ("b", 540, 1)])            # (2, a, 20) came too late
    assert held[0] == 12 and held[1] == 1 and held[-1] == 1                 # of 18 windows 6 were done at once


def test_sessions_expire(spark):
    rows = [(0, "a", 0), (0, "a", 20), (0, "b", 100), (1, "a", 110), (1, "a", 125), (2, "a", 400), (2, "b", 90), (3, "a", 9000)]
    out, held, minute = _fed(spark, rows, lambda s: E.session_rollup(s, "ts", ["key"], "value", "30 minutes", watermark="20 minutes"), "s")
    got = sorted((r.key, minute(r.session_start), minute(r.session_end), r.events) for r in out.collect())
    assert got == [("a", 0, 50, 2), ("a", 110, 155, 2), ("a", 400, 430, 1), ("b", 90, 130, 2)]
    assert held == [1, 2, 1, 1]


def test_keys_are_forgotten_after_the_watermark(spark):
    from keelson.streaming.batches import dedupe_within
    rows = [(0, f"k{i}", i) for i in range(50)] + [(1, f"k{i}", i) for i in range(50)] + [(2, "x", 500), (3, "k1", 1), (3, "x", 500)]
    out, held, _ = _fed(spark, rows, lambda s: dedupe_within(s, ["key"], "ts", "1 hour"), "d")
    assert sorted(r.key for r in out.collect()) == sorted([f"k{i}" for i in range(50)] + ["x"])
    assert held[0] == held[1] == 50 and held[2] == held[3] == 1


def test_no_arrivals(spark):
    out, held, _ = _fed(spark, [(0, "a", 0)], lambda s: E.windowed_rollup(s.where("false"), "ts", ["key"], "value", "1 hour", watermark="1 hour"), "n")
    assert out.count() == 0 and held == [0]
