"""Writes and exports (L6, L10-L13, E8 layout).

Outputs always go to a new path: state-returning operators must never
overwrite the input they read from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from keelson.session import cut_lineage

C = F.col


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_table(df: DataFrame, path: str, mode: str = "create", partition_by=None) -> None:
    """Create (fail if exists) / append (fail if missing, or if a column is not in the table) / replace.

    ``sources.publish`` checks several tables before they replace published ones together.
    """
    spark = df.sparkSession
    exists = _exists(spark, path)
    if mode == "create" and exists:
        raise FileExistsError(f"Table already exists: {path}")
    if mode == "append" and not exists:
        raise FileNotFoundError(f"Table does not exist: {path}")
    if mode == "append":
        have = set(spark.read.parquet(path).columns)
        missing = [c for c in df.columns if c not in have and c not in (partition_by or [])]
        if missing:
            raise ValueError(f"Append target is missing columns: {', '.join(missing)}")
    spark_mode = {"create": "errorifexists", "append": "append", "replace": "errorifexists"}[mode]
    w = df.write.mode(spark_mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if mode != "replace" or not exists:
        w.parquet(path)
        return
    # the new table is whole before the old one moves aside; a write that fails leaves the old one as it is
    base, tag = path.rstrip("/"), uuid.uuid4().hex
    staged, aside = f"{base}.staged-{tag}", f"{base}.replaced-{tag}"
    w.parquet(staged)
    jvm = spark.sparkContext._jvm
    at = {p: jvm.org.apache.hadoop.fs.Path(p) for p in (base, staged, aside)}
    fs = at[base].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(at[base], at[aside]):
        raise OSError(f"Cannot move {base} aside")
    if not fs.rename(at[staged], at[base]):
        fs.rename(at[aside], at[base])
        raise OSError(f"Cannot put the new table at {base}")
    fs.delete(at[aside], True)


def event_sink(events: DataFrame, path: str, mode: str = "append", max_records_per_file: int = 5_000_000,
               rejected_path: str | None = None) -> None:
    """Accepted events, one folder per collection and day, sorted by (system, time desc).

    Rejected events go to ``rejected_path`` (default: ``path`` + ``_rejected``) with their reason and body.
    The judged events are written once to the shared folder first, so that the range
    sampling and the two writes do not run the checks again.

    Range partitioning on (collection, day, system, time) keeps each task's
    rows in few folders while splitting a hot (collection, day) -- one that
    holds a third of all events -- over many tasks; every file is sorted in
    the reference's index order (system_key, timestamp desc).
    """
    events = cut_lineage(events)
    bad = events.where(C("reject_reason").isNotNull())
    bad.write.mode(mode).parquet(rejected_path or path.rstrip("/") + "_rejected")
    out = (events.where(C("reject_reason").isNull())
           .withColumn("event_date", F.to_date("timestamp"))
           .repartitionByRange("collection", "event_date", "system_key", C("timestamp").desc())
           .sortWithinPartitions("collection", "event_date", "system_key", C("timestamp").desc()))
    (out.write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
     .partitionBy("collection", "event_date").parquet(path))


def event_store(events: DataFrame, path: str, max_records_per_file: int = 1_000_000) -> None:
    """L10/E8 layout for reads of one system: one folder per collection, files ordered by (system, time desc).

    Every file holds a narrow range of systems, so its minimum and maximum let a query for
    one system skip nearly all files; a system with very many events fills files of its own.
    """
    events = cut_lineage(events)
    keys = ["collection", "system_key", C("timestamp").desc()]
    (events.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("append")
     .option("maxRecordsPerFile", max_records_per_file).partitionBy("collection").parquet(path))


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*[F.to_json(C(f"`{f.name}`")).alias(f.name)
                       if isinstance(f.dataType, (StructType, MapType, ArrayType)) else C(f"`{f.name}`")
                       for f in df.schema.fields])


def csv_lines(df: DataFrame) -> DataFrame:
    """L11 line builder: every non-null value quoted ("" doubled), NULL -> empty unquoted field."""
    flat = _flat(df)
    cells = [F.when(C(f"`{c}`").isNull(), F.lit(""))
             .otherwise(F.concat(F.lit('"'), F.replace(C(f"`{c}`").cast("string"), F.lit('"'), F.lit('""')),
                                 F.lit('"'))) for c in flat.columns]
    return flat.select(F.concat_ws(",", *cells).alias("value"))


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Quoted lines written as text (so NULL and '' stay distinct), a header on every file.

    Files are written in parallel, one per partition; the first line of each carries the
    header in front of it.  ``single_file=True`` funnels a small result through one task
    into one file.  A frame without rows becomes one file with the header alone.
    """
    header = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    lines = csv_lines(df)
    if lines.isEmpty():
        lines = df.sparkSession.range(0, 1, 1, 1).select(F.lit(header).alias("value"))
    else:
        lines = lines.coalesce(1) if single_file else lines
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0       # row 0 of its partition
        lines = lines.select(F.when(first, F.concat(F.lit(header + "\n"), "value")).otherwise(C("value")).alias("value"))
    lines.write.mode("errorifexists").text(path)


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines, NULL fields written as null (not dropped)."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def freeze_rows(df: DataFrame, order: list, path: str, metadata: dict, limit: int | None = None) -> None:
    """Save the result rows (the first ``limit`` in ``order`` if given) with the chart metadata columns."""
    out = df.orderBy(*order)
    if limit is not None:
        out = out.limit(limit)
    for k, v in metadata.items():
        out = out.withColumn(k, F.lit(v))
    out.write.mode("errorifexists").parquet(path)
