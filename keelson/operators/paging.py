"""Ordered arrays and strings per key, cut into numbered pages of bounded size.

A key with any number of rows yields pages; no row of the result, and no task, holds more
than one page of a key at a time.  The places of the rows come from running counts over
range partitions (``operators.ordering``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.operators.ordering import running_by_key

C = F.col
PAGE = 1000


def pages(df: DataFrame, key: str, order: list, size: int = PAGE) -> DataFrame:
    """``df`` with ``page`` (from 1) and ``place`` (from 1 inside the page) of each row of a key, in ``order``."""
    numbered = running_by_key(df.withColumn("_one", F.lit(1).cast("long")), key, order, "_one", "_n").drop("_one")
    return numbered.withColumn("page", F.expr(f"(_n - 1) div {size} + 1")).withColumn(
        "place", C("_n") - (C("page") - 1) * size).drop("_n")


def paged_arrays(df: DataFrame, key: str, order: list, value: Column, name: str = "values", size: int = PAGE) -> DataFrame:
    """(key, page, n, ``name``): arrays of at most ``size`` values in order; joined page by page they are the whole list."""
    p = pages(df.withColumn("_value", value), key, order, size)
    rows = F.sort_array(F.collect_list(F.struct("place", C("_value").alias("v"))))
    return p.groupBy(key, "page").agg(F.count(F.lit(1)).alias("n"), rows.alias("_rows")).select(
        key, "page", "n", F.transform("_rows", lambda x: x["v"]).alias(name))


def paged_strings(df: DataFrame, key: str, order: list, value: Column, name: str = "line", sep: str = ", ", size: int = PAGE) -> DataFrame:
    """A9 as pages: (key, page, n, ``name``), strings of at most ``size`` values joined by ``sep``."""
    p = paged_arrays(df, key, order, value, "_values", size)
    return p.select(key, "page", "n", F.array_join("_values", sep).alias(name))


def lookup_pages(outer: DataFrame, inner: DataFrame, on: str, order: list, value: Column, name: str = "matches",
                 size: int = PAGE) -> DataFrame:
    """D8 as pages: the outer rows with (page, n, ``name``); a row without matches has one empty page 1.

    ``on`` names the column both sides share.
    """
    found = paged_arrays(inner.where(C(on).isNotNull()), on, order, value, name, size)
    j = outer.join(found, on, "left")
    kind = found.schema[name].dataType
    return j.select(*outer.columns, F.coalesce("page", F.lit(1)).cast("long").alias("page"), F.coalesce("n", F.lit(0)).alias("n"),
                    F.coalesce(C(name), F.array().cast(kind)).alias(name))
