"""Shards by fixed virtual slots and a versioned slot map.

Every record hashes into one of a fixed number of virtual slots.  Bytes are added up per
slot, and a small table maps slots to shards.  Rebalancing edits that table alone: a shard
keeps its largest slots up to an equal share of all bytes, what it holds beyond that is
freed and goes, largest slot first, to the shard that is lightest at the time.  Each edit is
a new version of the table; records never hash anew.

Only DataFrame functions are used.  Rows that agree in id, size and checksum are counted
first, and a group of more than PIECE copies is cut into pieces that hash on their own, so
a group of copies spreads over slots and shards and is never numbered one by one in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.session import cut_lineage

from .text import pick

SHARDS, SLOTS = 24, 4096
PIECE = 64                  # equal rows that stay together at most
BLOCK = PIECE << 10         # rows of a group that are cut into pieces at once
EXTRA = 8                   # bytes a record takes besides its text
LAW = "bytes"


def record(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32) of each row; a null text has no bytes and checksum 0."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return pick(docs, doc_id="long", text="string").select(
        "doc_id", (F.octet_length(text) + EXTRA).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def slot_of(piece: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record, or of a piece of equal ones: a hash of id, checksum, size and piece."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size", piece)
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % slots).cast("int")


def pieces(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, piece, n, vslot): equal records as pieces of at most PIECE rows."""
    groups = records.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("m"))
    # two steps, so that no array of a very large group is long
    each = lambda rows, size: F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({rows} - 1) div {size}")))
    cut = groups.withColumn("block", each("m", BLOCK))
    cut = cut.withColumn("k", each(f"least(m - block * {BLOCK}, {BLOCK})", PIECE))
    cut = cut.withColumn("piece", F.col("k") + F.col("block") * (BLOCK // PIECE))
    n = F.least(F.lit(PIECE), F.col("m") - F.col("piece") * PIECE).cast("long")
    return cut.select("doc_id", "size", "text_crc32", "piece", n.alias("n"), slot_of(F.col("piece"), slots).alias("vslot"))


def slot_totals(cut: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, rows) of every slot, empty ones too: ``slots`` rows at any size of the input."""
    found = cut.groupBy("vslot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows"))
    every = cut.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(found, "vslot", "left").select(
        "vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def even_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(vslot, shard): the first version, which knows no sizes."""
    return spark.range(slots).select(F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalanced(current: DataFrame, totals: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(vslot, shard): the next version of the map for ``shards`` shards, which may be more or fewer than before.

    Slots of shards that are gone are freed whole.  The one-row steps hold ``slots`` values.
    """
    t = current.join(totals, "vslot").crossJoin(totals.agg(F.sum("bytes").alias("all")))               # one row
    down = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    stays = (F.col("shard") < shards) & (F.sum("bytes").over(down) * shards <= F.col("all"))
    t = t.withColumn("stays", stays)
    loads = t.where("stays").groupBy("shard").agg(F.sum("bytes").alias("load"))
    every = current.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    loads = every.join(loads, "shard", "left").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0)).alias("load")))), lambda x: x["load"]).alias("loads"))
    freed = t.where("not stays").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("bytes")).alias("less"), "vslot"))).alias("freed"))

    def give(done, slot):
        to = F.array_position(done["loads"], F.array_min(done["loads"])).cast("int")
        heavier = F.transform(done["loads"], lambda v, i: F.when(i + 1 == to, v - slot["less"]).otherwise(v))
        return F.struct(heavier.alias("loads"), F.concat(done["moves"], F.array(to - 1)).alias("moves"))

    start = F.struct(F.col("loads"), F.array().cast("array<int>").alias("moves"))
    moves = F.aggregate("freed", start, give, lambda done: done["moves"])
    moved = loads.crossJoin(freed).select(F.explode(F.arrays_zip(F.col("freed.vslot").alias("vslot"), moves.alias("shard"))).alias("m"))
    return t.where("stays").select("vslot", "shard").union(moved.select("m.vslot", "m.shard"))


def commit_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Add a version of the map to the table at ``path``; an existing version is refused."""
    slot_map.coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(vslot, shard, version): one version of the map, the newest unless named."""
    all_ = spark.read.parquet(path)
    if version is None:
        version = all_.agg(F.max("version")).first()[0]
    return all_.where(F.col("version") == version)


def placed(cut: DataFrame, slot_map: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, vslot, version): one row per record.

    ``slot`` counts the records of a shard from 0 without gaps: slots of the map in order,
    records in a slot by id.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    ahead = slot_map.join(totals, "vslot").select(
        "vslot", "shard", "version", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("vslot").orderBy(F.asc_nulls_last("doc_id"), "text_crc32", "size", "piece") \
        .rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumn("run", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(ahead), "vslot")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("ahead") + F.col("run") + F.col("k")).alias("slot"),
                       "vslot", "version")


def shard(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, version), one row per input row.

    The first version of the map is even, the second balances the bytes of the shards; both
    are kept at ``path``.  Null texts take ``EXTRA`` bytes; null ids hash as the empty id;
    rows that repeat each have a place.  Extra columns are ignored; an empty table gives no
    rows.
    """
    spark = docs.sparkSession
    cut = cut_lineage(pieces(record(docs), slots))
    totals = cut_lineage(slot_totals(cut, slots))
    commit_map(even_map(spark, shards, slots), path, 1)
    commit_map(rebalanced(read_map(spark, path, 1), totals, shards), path, 2)
    out = placed(cut, read_map(spark, path), totals)
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "vslot", "version")


def write_shards(docs: DataFrame, map_path: str, out_path: str, slots: int = SLOTS, tasks_a_shard: int = 8) -> None:
    """Write ``docs``, all columns, to one folder per shard of the newest map, each by several tasks.

    Of a group of more than PIECE equal rows, each row joins one of its pieces at random (the
    rows are equal, so shards stay near their planned sizes).
    """
    # the record's columns stand in a struct, so no column of the table can clash
    text = F.coalesce(F.col("`text`").cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("`doc_id`").cast("long").alias("doc_id"),
                       (F.octet_length(text) + EXTRA).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    large = record(docs).groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > PIECE)
    g = large.select(F.col("doc_id").alias("g_id"), F.col("size").alias("g_size"), F.col("text_crc32").alias("g_crc"),
                     F.expr(f"(m - 1) div {PIECE} + 1").alias("parts"))
    rows = rows.join(g, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("size") == F.col("g_size"))
                     & (F.col("text_crc32") == F.col("g_crc")), "left")
    piece = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("piece", piece).withColumn("vslot", slot_of(F.col("piece"), slots))
    by_slot = read_map(docs.sparkSession, map_path).select("vslot", F.col("shard").alias("_shard"))
    out = rows.join(F.broadcast(by_slot), "vslot").select("_shard", F.pmod("vslot", F.lit(tasks_a_shard)).alias("_task"), "row")
    out.repartition("_shard", "_task").select(F.col("_shard").alias("shard"), "row").write.partitionBy("shard").parquet(out_path)
