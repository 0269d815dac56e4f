"""Global order without a window over the whole table.

Rows are range-partitioned on the order columns and sorted inside their partition; each
partition's row count and sums become offsets (one small row per partition), so numbers
and running totals over all rows need no task that sees them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.session import cut_lineage

ROW_BITS = 33               # fixed value: monotonically_increasing_id keeps the row of a partition in its low bits


def _laid_out(df: DataFrame, keys: list[Column]) -> DataFrame:
    """``df`` range-partitioned and sorted on ``keys``, with ``_part`` and the row's place in it, ``_row`` (from 0).

    Rows that tie may be spread over partitions, so a value that most rows share does not
    fill one task.  The rows are checkpointed: range bounds are sampled, so a second
    evaluation could differ.
    """
    laid = df.withColumn("_tie", F.monotonically_increasing_id())
    laid = laid.repartitionByRange(*keys, F.col("_tie")).sortWithinPartitions(*keys, F.col("_tie"))
    laid = cut_lineage(laid.withColumn("_id", F.monotonically_increasing_id()).drop("_tie"))
    laid = laid.withColumn("_part", F.shiftright("_id", ROW_BITS))
    return laid.withColumn("_row", F.col("_id") - F.shiftleft("_part", ROW_BITS)).drop("_id")


def _columns(order: list) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c) for c in order]


def running_by_key(df: DataFrame, key: str, order: list, value: str, name: str = "running_total") -> DataFrame:
    """``df`` with the exact running SUM of ``value`` per ``key`` in ``order``, this row included.

    The rows are laid out by (key, order), so a key that holds most rows fills as many
    partitions as its rows need; the totals of a key's earlier partitions are carried into
    the next.  NULL values add nothing; NULL keys are one key.
    """
    laid = _laid_out(df, [F.col(key), *_columns(order)])
    totals = laid.groupBy("_part", key).agg(F.sum(value).alias("_sum"))             # keys plus partitions at most
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(F.col("_part").alias("_p"), F.col(key).alias("_k"), F.sum("_sum").over(before).alias("_ahead"))
    inside = Window.partitionBy("_part", key).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    out = laid.withColumn("_own", F.sum(value).over(inside))
    out = out.join(ahead, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")))
    zero = F.lit(0)
    return out.withColumn(name, F.coalesce("_ahead", zero) + F.coalesce("_own", zero)).drop(
        "_part", "_row", "_own", "_ahead", "_p", "_k")


def in_order(df: DataFrame, order: list, number: str = "position", running: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with ``number``, its 1-based place in ``order`` over all rows, and running totals.

    ``running`` maps a new column to a numeric expression; the column holds the total of
    that expression over all rows before this one (NULL values add nothing; the first row
    has 0).  Rows that tie are numbered in the order they were read.
    """
    running = running or {}
    laid = _laid_out(df.withColumns({f"_value_{n}": e for n, e in running.items()}), _columns(order))
    totals = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_value_{n}").alias(f"_sum_{n}") for n in running])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)         # one row per partition
    ahead = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"), *[
        F.sum(f"_sum_{n}").over(before).alias(f"_ahead_{n}") for n in running])
    out = laid.join(F.broadcast(ahead), "_part").withColumn(number, (F.col("_rows") + F.col("_row") + 1).cast("long"))
    if running:
        inside = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        for n in running:
            own = F.sum(f"_value_{n}").over(inside)
            zero = F.col(f"_value_{n}") * 0
            out = out.withColumn(n, F.coalesce(own + F.col(f"_ahead_{n}"), own, F.col(f"_ahead_{n}"), zero, F.lit(0)))
    return out.drop("_part", "_row", "_rows", *[f"_{k}_{n}" for n in running for k in ("value", "ahead")])
