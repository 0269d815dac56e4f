"""Baseline snapshot, restore and reconciliation.

Live and baseline tables are compared by key with null-safe equality; every
comparison is one join (or one grouped aggregate per side) plus a global
count, so nothing is brought to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators.changes import delete_where, one_per_key

C = F.col


def snapshot(material_lots: DataFrame, material_catalog: DataFrame, statuses: Sequence[str] | None = None) -> DataFrame:
    """Refill the lot baseline from the current lots (with the material code joined in)."""
    lots = material_lots
    if statuses is not None:
        lots = lots.where(C("status").isin(list(statuses)))
    return (lots.select("internal_lot_number", "supply_material_id", "available_quantity", "reserved_quantity",
                        "status")
            .join(material_catalog.select("supply_material_id", "material_code"), "supply_material_id")
            .select("internal_lot_number", "material_code", "available_quantity", "reserved_quantity", "status"))


def mirror_status(status):
    """Status in the mirror vocabulary -- available/released in any case -> Released, else initcap."""
    s = C(status) if isinstance(status, str) else status
    return F.when(F.lower(s).isin("available", "released"), F.lit("Released")).otherwise(F.initcap(s))


def restore(live: DataFrame, baseline: DataFrame, key: str = "internal_lot_number",
            cols: Sequence[str] = ("available_quantity", "reserved_quantity")) -> DataFrame:
    """R2: live columns := baseline by key; status remapped released (in any case) -> available.

    Rows without a baseline keep their values; of several baseline rows for a key the
    smallest counts.  Adds ``mirror_status``.  ``operators.restore`` restores all tables of
    a snapshot together.
    """
    b = one_per_key(baseline.select(key, *cols, "status"), key)
    b = b.select(key, *[C(c).alias(f"_b_{c}") for c in cols], C("status").alias("_b_status"), F.lit(True).alias("_b_hit"))
    j = live.join(b, key, "left")
    out = []
    for c in live.columns:
        if c in cols:
            out.append(F.when(C("_b_hit"), C(f"_b_{c}")).otherwise(C(c)).alias(c))
        elif c == "status":
            remap = F.when(F.lower("_b_status") == "released", F.lit("available")).otherwise(C("_b_status"))
            out.append(F.when(C("_b_hit"), remap).otherwise(C(c)).alias(c))
        else:
            out.append(C(c))
    res = j.select(*out)
    return res.withColumn("mirror_status", mirror_status("status"))


def rebuild_staged(staged: DataFrame, baseline_staged: DataFrame, scope=None) -> DataFrame:
    """R2 staged rows: delete the live staged rows in scope (DELETE keeps rows whose test
    is NULL) and insert the baseline rows of that scope again."""
    cond = scope if scope is not None else F.lit(True)
    kept = delete_where(staged, cond)
    fresh = baseline_staged.where(cond) if scope is not None else baseline_staged
    return kept.unionByName(fresh.select(*staged.columns))


def _differs(cols):
    d = F.lit(False)
    for c in cols:
        d = d | ~C(f"_l_{c}").eqNullSafe(C(f"_b_{c}"))
    return d


def mismatch_count(live: DataFrame, baseline: DataFrame, key: str, cols: Sequence[str], how: str = "inner",
                   remap: dict | None = None) -> DataFrame:
    """Rows that differ null-safely on ``cols``.

    ``inner`` ignores keys missing on either side; ``left`` (baseline left
    join live) also counts baseline rows missing from live.  ``remap`` gives baseline
    columns (name -> expression) as a restore writes them, so that a right restore has none.
    """
    baseline = baseline.withColumns(remap or {})
    lv = live.select(key, *[C(c).alias(f"_l_{c}") for c in cols], F.lit(True).alias("_l_hit"))
    bs = baseline.select(key, *[C(c).alias(f"_b_{c}") for c in cols])
    if how == "inner":
        j = bs.join(lv, key, "inner")
        bad = _differs(cols)
    else:
        j = bs.join(lv, key, "left")
        bad = C("_l_hit").isNull() | _differs(cols)
    return j.agg(F.count_if(bad).alias("mismatches"), F.count(F.lit(1)).alias("compared"))


def grouped_totals(df: DataFrame, group: str, sums: Sequence[str]) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("row_count"),
                                 *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in sums])


def group_diff(baseline: DataFrame, live: DataFrame, group: str, sums: Sequence[str], both: bool = True) -> DataFrame:
    """Grouped sums of baseline EXCEPT live (U2); with ``both`` the symmetric difference.

    Set semantics as SQL EXCEPT (distinct rows, NULLs equal): the two grouped
    sides are tagged, unioned and grouped on every value column once -- one
    shuffle answers both directions -- and a row is kept when only one side
    has it.  A ``side`` column says which.
    """
    b = grouped_totals(baseline, group, sums).withColumn("_side", F.lit(0))
    lv = grouped_totals(live, group, sums).withColumn("_side", F.lit(1))
    values = [c for c in b.columns if c != "_side"]
    g = (b.unionByName(lv).groupBy(*values)
         .agg(F.max(C("_side") == 0).alias("_in_b"), F.max(C("_side") == 1).alias("_in_l")))
    side = F.when(C("_in_b") & ~C("_in_l"), F.lit("baseline_only")).when(C("_in_l") & ~C("_in_b"), F.lit("live_only"))
    out = g.withColumn("side", side).where(C("side").isNotNull())
    if not both:
        out = out.where(C("side") == "baseline_only")
    return out.select(*values, "side")


def before_after(before: DataFrame, after: DataFrame, qty: str) -> DataFrame:
    """Row count and COALESCE(SUM(qty), 0) before and after, one row."""
    a = before.agg(F.count(F.lit(1)).alias("rows_before"), F.coalesce(F.sum(qty), F.lit(0)).alias("qty_before"))
    z = after.agg(F.count(F.lit(1)).alias("rows_after"), F.coalesce(F.sum(qty), F.lit(0)).alias("qty_after"))
    return a.crossJoin(z)  # one row x one row


def verify_counts(actual: DataFrame, expected: DataFrame, name: str) -> DataFrame:
    """Compare a table's row count with the required count (``expected`` has one row ``n``)."""
    n = actual.agg(F.count(F.lit(1)).alias("actual"))
    return (n.crossJoin(expected.select(C("n").alias("expected")))
            .select(F.lit(name).alias("table_name"), "expected", "actual",
                    (C("expected") == C("actual")).alias("ok")))
