"""Chart and dashboard data (G1-G5): points, scale, pie shares, keys, dashboard counts.

Row numbers and running offsets come from a range sort with partition offsets
(``operators.ordering``), so no task sees all rows.  Nothing is cut off unless the
caller passes a limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators.ordering import in_order

C = F.col


def numeric_value(c):
    """Finite number, or text that parses as a finite number; otherwise NULL."""
    v = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def chart_points(df: DataFrame, x: str | None, y: str, order: list, limit: int | None = None) -> DataFrame:
    """G1: (position, label, value) of the rows, in ``order``, that have a numeric y (the first ``limit`` if given).

    label = x as text, else the 1-based row position, taken before
    non-numeric rows are dropped, as in the UI.
    """
    top = in_order(df, order, "_pos").withColumn("_value", numeric_value(C(y))).where(C("_value").isNotNull())
    if limit is not None:
        top = top.orderBy("_pos").limit(limit)
    label = F.coalesce(C(x).cast("string"), C("_pos").cast("string")) if x else C("_pos").cast("string")
    return top.select(C("_pos").cast("long").alias("position"), label.alias("label"), C("_value").alias("value"))


def chart_scale(points: DataFrame, height: float = 330.0, pad: float = 42.0) -> DataFrame:
    """min(0, values), max, span (0 -> 1) and the scaled y of each point."""
    s = points.agg(F.least(F.lit(0.0), F.min("value")).alias("min_value"), F.max("value").alias("max_value"))
    s = s.withColumn("span", F.when((C("max_value") - C("min_value")) == 0, F.lit(1.0))
                     .otherwise(C("max_value") - C("min_value")))
    j = points.crossJoin(s)  # one-row frame
    y = F.lit(height - pad) - (C("value") - C("min_value")) / C("span") * F.lit(height - pad * 2)
    return j.select("position", "label", "value", "min_value", "max_value", "span", y.alias("y"))


def pie_shares(points: DataFrame) -> DataFrame:
    """Positive values only; share of the total and the running offset before each slice."""
    pos = points.where(C("value") > 0)
    total = pos.agg(F.sum("value").alias("_total"))
    j = in_order(pos, ["position"], "_place", {"_before": C("value")}).crossJoin(total)  # one-row frame
    share = C("value") / C("_total")
    return j.select("position", "label", "value", share.alias("fraction"),
                    (C("_before") / C("_total")).alias("offset"))


def result_keys(rows: DataFrame, json_col: str) -> DataFrame:
    """Distinct field names of all result documents."""
    return rows.select(F.explode(F.json_object_keys(C(json_col))).alias("key")).distinct()


def dashboard_summary(charts: DataFrame, dashboard: str, system: str | None = None) -> DataFrame:
    """Charts on a dashboard (optionally one system; none -> 'Unassigned') with counts.

    ``charts``: chart_id, dashboard_name, collection, system_key, data_points.
    """
    sys_ = F.coalesce(C("system_key"), F.lit("Unassigned"))
    c = charts.where(C("dashboard_name") == dashboard)
    if system is not None:
        c = c.where(sys_ == system)
    return c.agg(F.count(F.lit(1)).alias("charts"), F.count_distinct("collection").alias("collections"),
                 F.count_distinct(sys_).alias("systems"),
                 F.coalesce(F.sum("data_points"), F.lit(0)).cast("long").alias("data_points"))
