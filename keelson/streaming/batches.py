"""Streams fed batch by batch, with state that is dropped when it is no longer needed.

``run_batches`` plays a table into a stream the way a scheduled job meets it: each batch of
arrivals lands as new files, the query runs over what is new (``availableNow``) and stops,
and the next run goes on from the checkpoint.  All transforms run in append mode under a
short watermark: a window, session or key leaves the state when the watermark passes it, and
rows that come later than the watermark allows are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.session import scratch_path

C = F.col


def dedupe_within(events: DataFrame, keys: list[str], ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """The first arrival of each key; a key is forgotten ``watermark`` after its event time.

    Repeats that arrive within the watermark are dropped by the state, later ones as late rows.
    """
    return (events.withColumn(ts, C(ts).cast("timestamp")).withWatermark(ts, watermark)
            .dropDuplicatesWithinWatermark(keys).withColumn(ts, C(ts).cast("timestamp_ntz")))


def run_batches(arrivals: DataFrame, batch: str, transform: Callable[[DataFrame], DataFrame],
                name: str) -> tuple[DataFrame, list[int]]:
    """The append output of ``transform`` over ``arrivals``, one run per value of ``batch`` in order,
    and the number of rows the state held after each run.

    The numbers of batches come to the driver, rows do not.  A run that is lost is repeated
    from the checkpoint; the file sink's log keeps its output exactly once.
    """
    spark = arrivals.sparkSession
    run = f"{name}-{uuid.uuid4().hex}"
    staged, source, out, ck = (scratch_path(spark, f"{kind}-{run}") for kind in ("staged", "arrived", "stream-out", "stream-ckpt"))
    arrivals.write.partitionBy(batch).parquet(staged)
    rows = spark.read.parquet(staged)
    fields = [f for f in arrivals.schema.fields if f.name != batch]
    order = [r[0] for r in rows.select(batch).distinct().orderBy(batch).collect()]
    held = []
    for k, value in enumerate(order):
        rows.where(C(batch) == value).select(*[f.name for f in fields]).write.parquet(f"{source}/arrived-{k:06d}")
        new = transform(spark.readStream.schema(_schema(fields)).parquet(f"{source}/*"))
        query = (new.writeStream.outputMode("append").option("checkpointLocation", ck).option("path", out)
                 .format("parquet").trigger(availableNow=True).start())
        query.awaitTermination()
        states = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
        held.append(states[-1] if states else 0)
    if not order:
        return spark.createDataFrame([], transform(arrivals.drop(batch)).schema), held
    return spark.read.schema(new.schema).parquet(out), held


def _schema(fields):
    from pyspark.sql.types import StructType
    return StructType(fields)
