"""Numbers and running totals over all rows, and what their plans look like."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keelson.operators import charts, ledger
from keelson.operators.ordering import running_by_key


@pytest.fixture
def spread(spark):
    """Partitions stay as dealt, and nothing is broadcast."""
    new = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_running_total_per_key(spread):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "a", "a", "b"]), r.randrange(50), i, r.choice([None, 1, 2, 3])) for i in range(2000)]
    df = spread.createDataFrame(rows, "k string, t int, i int, v int")
    seen, wanted = Counter(), []
    for k, t, i, v in sorted(rows, key=lambda x: (x[1], x[2])):
        seen[k] += v or 0
        wanted.append((k, t, i, v, seen[k]))
    assert Counter(map(tuple, running_by_key(df, "k", ["t", "i"], "v").collect())) == Counter(wanted)
    assert running_by_key(df.limit(0), "k", ["t", "i"], "v").count() == 0


def one_lot(spark, n):
    lines = spark.range(n).select(F.col("id").alias("material_request_line_id"), F.lit("L").alias("material_lot_id"),
                                  F.lit(1).cast("decimal(18,4)").alias("requested_quantity"),
                                  F.lit("2024-01-01").cast("timestamp_ntz").alias("requested_at"))
    lots = spark.createDataFrame([("L", 500)], "material_lot_id string, available_quantity int")
    return lines, lots, lines.limit(0).select("material_request_line_id")


def test_one_lot_spreads_over_tasks(spread):
    from keelson.operators.ordering import _laid_out
    lines, lots, none = one_lot(spread, 20000)
    laid = _laid_out(lines, [F.col("material_lot_id"), F.col("requested_at"), F.col("material_request_line_id")])
    sizes = sorted(x["count"] for x in laid.groupBy("_part").count().collect())
    assert len(sizes) == 8 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    out = ledger.reserve_in_order(lines, lots, none)
    assert plan(out).count("Exchange ") <= 10
    assert Counter(x.outcome for x in out.collect()) == {"reserved": 500, "shortage": 19500}
    assert out.where("outcome = 'reserved'").agg(F.max("running_demand")).first()[0] == 500


def test_charts_number_rows_without_one_task(spread):
    rows = spread.range(5000).select((F.col("id") * 37 % 5000).alias("n"), F.when(F.col("id") % 9 == 0, "x").otherwise("1.5").alias("y"))
    points = charts.chart_points(rows, None, "y", ["n"])
    assert [p.position for p in points.orderBy("position").limit(3).collect()] == [2, 3, 4]     # n = 0 is x
    shares = charts.pie_shares(points)
    assert abs(shares.agg(F.max(F.col("offset") + F.col("fraction"))).first()[0] - 1) < 1e-9
    for df in (points, shares):
        windows = [line for line in plan(df).splitlines() if "- Window [" in line]
        assert windows and all("[_part#" in line for line in windows), windows     # per partition, or over one row per partition
