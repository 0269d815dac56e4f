"""Structured Streaming forms of the ingest and roll-up operators.

The transforms are the batch functions themselves (column expressions and
stream-compatible joins), so a stream over the same rows gives the same
answer as the batch query.  State is bounded by watermarks; checkpoints go
under the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators import events as E
from keelson.operators import telemetry as T
from keelson.session import scratch_path

C = F.col


def read_stream(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """Parquet file source (new files are new micro-batches)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def ingest_stream(raw: DataFrame, systems: DataFrame, now=None, strict: bool = True) -> DataFrame:
    """E1-E6 on a stream: the registry is a static frame (stream-static joins); events are judged one by one,
    so the answer does not depend on how they arrive."""
    now = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
    x = E.validate_events(raw)
    x = E.route_events(x)
    x = E.resolve_system(x, systems, strict)
    x = E.normalize_ts(x, now)
    x = E.validate_keys(x)
    return E.envelope(x, now)


def route_to_collections(path: str, rejected_path: str | None = None):
    """``foreachBatch`` writer: one folder per collection and day; rejected events to their own folder."""
    from keelson.sources.sinks import event_sink

    def write(batch: DataFrame, epoch_id: int) -> None:
        event_sink(batch, path, rejected_path=rejected_path)
    return write


def windowed_rollup_stream(events: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """E9 on a stream: tumbling windows finalised by the watermark (append mode)."""
    return E.windowed_rollup(events, "ts", ["event_type"], "value", window, watermark=watermark)


def session_rollup_stream(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    return E.session_rollup(events, "ts", ["user_id"], "value", gap, watermark=watermark)


def dedupe_stream(events: DataFrame, keys: list[str], window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """E10 on a stream: one event per content key and clock ``window`` (the first to arrive).

    State is dropped when the watermark passes a window's start; the window's start is ``window_start``.
    """
    start = F.window(C("ts").cast("timestamp"), window).start
    ev = events.withColumn("window_start", start).withWatermark("window_start", watermark)
    return ev.dropDuplicates([*keys, "window_start"]).withColumn("window_start", C("window_start").cast("timestamp_ntz"))


def grid_snapshot_stream(readings: DataFrame, assets: DataFrame, tick: str = "1 hour",
                         watermark: str = "10 minutes") -> DataFrame:
    """V19-V21 on a stream: metrics per reading, then the per-tick snapshot."""
    r = readings.withColumn("recorded_at", C("recorded_at").cast("timestamp")).withWatermark("recorded_at", watermark)
    return T.grid_snapshot(T.electrical_metrics(r, assets), tick)


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive a stream over the available input into parquet under the shared checkpoint folder.

    Append mode uses the file sink (exactly-once via its commit log);
    complete mode rewrites the result table in ``foreachBatch``.  The result
    is read back as an ordinary distributed DataFrame -- nothing is held on
    the driver.  Each run gets fresh output and checkpoint folders.
    """
    spark = df.sparkSession
    run = f"{name}-{uuid.uuid4().hex}"
    out, ck = scratch_path(spark, f"stream-out-{run}"), scratch_path(spark, f"stream-ckpt-{run}")
    w = df.writeStream.outputMode(mode).option("checkpointLocation", ck).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out).start()
    else:
        q = w.foreachBatch(lambda batch, _id: batch.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
