"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the words its source has sent up to and
including it, in shuffled order, divided by the source's target.  All documents are
then taken in order of finish time until the total budget is used up.  A source whose
target exceeds its size goes round again, so each document stands in the queue as many
times as ``repeats`` allows.

Only DataFrame functions are used.  No task sorts a whole source: the shuffle key is
cut into ``slices`` ranges, running sums are taken inside one (source, slice), and the
small table of slice totals gives each its offset.  The global cut works the same way
on slices of the finish time; only the slice that holds the cut is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.session import cut_lineage

from .text import SPLIT, pick, words

WEIGHTS = (5, 2, 1)     # by place of the source in code point order, repeating


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text, SPLIT)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, weigh ``weights`` in turn and divide
    ``share`` times all words.  No target exceeds ``repeats`` times its source; what
    is cut off is divided again by weight, which ends at one level of words per unit
    of weight: with sources sorted by the level at which they fill up, the first
    prefix whose level is not above the next source's is the answer.
    One row per source, so single-task windows are small here.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * float(repeats))
    s = s.withColumn("fill", F.col("most") / F.col("w"))
    up = Window.orderBy("fill", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    s = (s.withColumn("budget", F.sum("source_size").over(everything) * float(share))
          .withColumn("before", F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)))
          .withColumn("rest_w", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing))))
    s = s.withColumn("level", (F.col("budget") - F.coalesce("before", F.lit(0.0))) / F.col("rest_w"))
    first = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("rank", "level"))).over(everything)
    s = s.withColumn("rank", F.row_number().over(up)).withColumn("cut", first["level"])
    target = F.when(F.col("cut").isNull() | (F.col("fill") <= F.col("cut")), F.col("most")) \
        .otherwise(F.col("w") * F.col("cut"))
    return s.select("source", "source_size", target.alias("target"))


def queue(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, share: float = 1.5, repeats: int = 2,
          slices: int = 4096) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken), one row per input row.

    A null text has size 0 and is taken 0 times, as is every document of a source
    without words.  A null source is a source of its own, last in order.  Rows that
    repeat (even with a null ``doc_id``) are queued one after the other.  Documents are
    shuffled by the MD5 of ``seed`` and ``doc_id``, so reruns agree.  ``copies`` is how
    often the mix takes the document, ``taken`` its words, copies included.  Extra
    columns are ignored; an empty table gives no rows.
    """
    d = pick(docs, doc_id="long", source="string", text="string").select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"))
    # slices of the key in its own order
    d = cut_lineage(d.withColumn("slice", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * slices / 2.0**32)
                                 .cast("int")))
    parts = d.groupBy("source", "slice").agg(F.sum("size").alias("part"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")),
                             weights, share, repeats)
    by_slice = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("part").over(by_slice), F.lit(0)))
    ahead = (parts.join(targets, parts["source"].eqNullSafe(targets["source"])).drop(targets["source"])
             .select(F.col("source").alias("p_source"), F.col("slice").alias("p_slice"), "offset", "source_size",
                     "target"))
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("run", F.sum("size").over(inside))
    d = d.join(ahead, d["source"].eqNullSafe(F.col("p_source")) & (d["slice"] == F.col("p_slice")))
    d = d.withColumn("cum", F.col("run") + F.col("offset")).drop("p_source", "p_slice", "run", "offset", "slice")
    # The mix fills its budget near virtual time 1, so slices of 1/slices of that time are fine grained.
    finish = F.array(*[(F.col("cum") + F.col("source_size") * r) / F.col("target") for r in range(repeats)])
    d = cut_lineage(d.withColumn("finish", F.when(F.col("target") > 0, finish)))
    stands = (d.where(F.col("size") > 0).select("doc_id", "key", "size", F.explode("finish").alias("finish"))
              .withColumn("slice", F.floor(F.col("finish") * slices)))
    totals = stands.groupBy("slice").agg(F.sum("size").alias("part"))
    budget = targets.agg(F.floor(F.sum("source_size") * float(share)).alias("budget"))
    upto = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    edge = (totals.withColumn("after", F.sum("part").over(upto)).crossJoin(budget)      # one-row side
            .where(F.col("after") > F.col("budget")).groupBy()
            .agg(F.min(F.struct("slice", (F.col("budget") - F.col("after") + F.col("part")).alias("room")))
                 .alias("edge")).select("edge.slice", "edge.room"))
    order = Window.partitionBy("slice").orderBy("finish", "key", "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, 0)
    last = (stands.join(F.broadcast(edge), "slice")                                       # one row
            .withColumn("run", F.sum("size").over(order)).where(F.col("run") <= F.col("room"))
            .groupBy().agg(F.max(F.struct("finish", "key", "doc_id", "size")).alias("last")))
    cut = edge.agg(F.max("slice").alias("edge_slice")).crossJoin(last)                    # one row each
    d = d.crossJoin(F.broadcast(cut))
    taken = F.filter("finish", lambda f: F.col("edge_slice").isNull()
                     | (F.floor(f * slices) < F.col("edge_slice"))
                     | (F.coalesce(F.struct(f.alias("finish"), F.col("key"), F.col("doc_id"), F.col("size"))
                                   <= F.col("last"), F.lit(False))))
    copies = F.when((F.col("size") > 0) & F.col("finish").isNotNull(), F.size(taken)).otherwise(0).cast("long")
    return d.withColumn("copies", copies).select(
        "doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row ``copies`` times (0 drops it), all columns kept.

    Repeated rows with one ``doc_id`` share its copies: each is taken as often as the
    mix took the most taken of them.
    """
    q = queue(docs, **options).where(F.col("copies") > 0)
    q = q.groupBy("doc_id").agg(F.max("copies").alias("_mix_copies")).withColumnRenamed("doc_id", "_mix_id")
    out = docs.join(q, F.col("`doc_id`").cast("long").eqNullSafe(F.col("_mix_id")))
    names = docs.columns
    out = out.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in names])
