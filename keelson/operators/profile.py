"""Column profiles kept as mergeable sketches (K3).

Each folder of a table is profiled once: counts, a HyperLogLog sketch of the distinct
values, a KLL sketch of the order of numbers, dates and times, and a frequent-items sketch.
The sketches are stored per folder; a refresh reads only folders that have none yet, and
the table's profile merges the stored ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

C = F.col
LOG_REGISTERS = 14          # of the distinct sketch: about 0.8 percent standard error
RANK_BITS = 400             # size of the quantile sketch: ranks within about 0.7 percent
TRACKED = 1000              # items of the frequent-items sketch


def sketches(df: DataFrame) -> DataFrame:
    """(column_name, data_type, ordinal, row_count, non_null, distinct, blank, ranks, frequent): one pass over ``df``.

    The distinct sketch leaves out empty texts, so ``blank`` counts them.
    """
    aggs = [F.count(F.lit(1)).alias("_rows")]
    kinds = []
    for i, f in enumerate(df.schema.fields):
        c = C(f"`{f.name}`")
        text = c.cast("string")
        number = None
        if isinstance(f.dataType, NumericType):
            number = c.cast("double")
        elif isinstance(f.dataType, (TimestampType, TimestampNTZType, DateType)):
            number = F.unix_micros(c.cast("timestamp")).cast("double")
        kinds.append(number is not None)
        aggs += [F.count(c).alias(f"_n{i}"), F.hll_sketch_agg(text, LOG_REGISTERS).alias(f"_d{i}"),
                 F.count_if(text == "").alias(f"_b{i}"),
                 F.expr(f"approx_top_k_accumulate(cast(`{f.name}` as string), {TRACKED})").alias(f"_t{i}")]
        if number is not None:
            aggs.append(F.kll_sketch_agg_double(number, RANK_BITS).alias(f"_q{i}"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(i).alias("ordinal"),
                     C("_rows").alias("row_count"), C(f"_n{i}").alias("non_null"),
                     C(f"_d{i}").alias("distinct"), C(f"_b{i}").alias("blank"),
                     (C(f"_q{i}") if kinds[i] else F.lit(None).cast("binary")).alias("ranks"),
                     C(f"_t{i}").alias("frequent"))
            for i, f in enumerate(df.schema.fields)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("row_count > 0")


def profiled(spark: SparkSession, store: str) -> list[str]:
    """Folders whose sketches are stored."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = [f.getPath() for f in fs.listStatus(root) if f.isDirectory() and f.getPath().getName().startswith("folder=")]
    return sorted(p.getName()[len("folder="):] for p in done
                  if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def refresh(spark: SparkSession, folders: dict[str, str], store: str) -> list[str]:
    """Profile the folders (name -> path) that ``store`` does not know yet; their names are returned.

    A folder whose write broke off has no mark and is profiled again.
    """
    known = set(profiled(spark, store))
    new = [name for name in sorted(folders) if name not in known]
    for name in new:
        sketches(spark.read.parquet(folders[name])).coalesce(1).write.mode("overwrite").parquet(f"{store}/folder={name}")
    return new


def merged_profile(spark: SparkSession, store: str, top: int = 5) -> DataFrame:
    """(column_name, data_type, ordinal, row_count, non_null, distinct_values, low, median, high, frequent) over all stored folders.

    ``low``, ``median`` and ``high`` (numbers, and times in microseconds) come from the rank
    sketch; ``frequent`` has the ``top`` items with their counts.  A null counts as no
    distinct value.
    """
    rows = spark.read.parquet(*[f"{store}/folder={name}" for name in profiled(spark, store)])
    m = rows.groupBy("column_name", "data_type", "ordinal").agg(
        F.sum("row_count").alias("row_count"), F.sum("non_null").alias("non_null"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("_d"), F.kll_merge_agg_double("ranks").alias("_q"), F.sum("blank").alias("_blank"),
        F.count("ranks").alias("_ranked"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(frequent, {TRACKED}), {top})").alias("frequent"))
    at = lambda q: F.when((C("_ranked") > 0) & (C("non_null") > 0), F.kll_sketch_get_quantile_double("_q", F.lit(q)))
    return m.select("column_name", "data_type", "ordinal", "row_count", "non_null",
                    (C("_d") + (C("_blank") > 0).cast("long")).alias("distinct_values"),
                    at(0.0).alias("low"), at(0.5).alias("median"), at(1.0).alias("high"), "frequent")


def profile_store(spark: SparkSession, name: str) -> str:
    """A new folder for sketches in the shared one."""
    from keelson.session import scratch_path
    return scratch_path(spark, f"profile-{name}-{uuid.uuid4().hex}")
