"""Ordered selection (W1-W3) and the recipe expansion.

Top-1-per-group is written as ``min(struct(order keys..., payload...))`` per
group instead of a window: the aggregate runs partially on the map side, so a
group holding a third of the rows is reduced in every task before the
shuffle and no task has to sort a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators.charts import numeric_value

C = F.col


def fefo_lot_choice(material_catalog: DataFrame, material_lots: DataFrame) -> DataFrame:
    """Per material the released lot with the earliest expiry (NULL last), ties by lot number."""
    lots = (material_lots.where(C("status") == "released")
            .groupBy("supply_material_id")
            .agg(F.min(F.struct(C("expiry_date").isNull().alias("_null_expiry"), "expiry_date",
                                "internal_lot_number", "material_lot_id")).alias("_best")))
    return (material_catalog.select("material_code", "supply_material_id")
            .join(lots, "supply_material_id")
            .select("material_code", "supply_material_id", C("_best.material_lot_id").alias("material_lot_id"),
                    C("_best.internal_lot_number").alias("internal_lot_number"),
                    C("_best.expiry_date").alias("expiry_date")))


def lateral_top1(material_catalog: DataFrame, material_lots: DataFrame, lot_like: str = "%-02") -> DataFrame:
    """Per material the lowest lot number matching ``lot_like`` (LATERAL ... ORDER BY LIMIT 1)."""
    lots = (material_lots.where(C("internal_lot_number").like(lot_like))
            .groupBy("supply_material_id")
            .agg(F.min(F.struct("internal_lot_number", "material_lot_id")).alias("_best")))
    return (material_catalog.select("material_code", "supply_material_id")
            .join(lots, "supply_material_id")
            .select("material_code", "supply_material_id", C("_best.material_lot_id").alias("material_lot_id"),
                    C("_best.internal_lot_number").alias("internal_lot_number")))


def first_numeric_key(df: DataFrame, keys=None) -> DataFrame:
    """The first column (in column order) with at least one value that reads as a number.

    One aggregate over all columns; returns one row ``first_numeric_key`` (NULL if none).
    """
    keys = list(keys or df.columns)
    flags = [F.max(numeric_value(C(f"`{k}`")).isNotNull().cast("int")).alias(f"_{i}")
             for i, k in enumerate(keys)]
    agg = df.agg(*flags)
    pick = F.lit(None).cast("string")
    for i, k in reversed(list(enumerate(keys))):
        pick = F.when(F.coalesce(C(f"_{i}"), F.lit(0)) == 1, F.lit(k)).otherwise(pick)
    return agg.select(pick.alias("first_numeric_key"))


def recipe_expand(batches: DataFrame, recipe: DataFrame, materials: DataFrame, material_catalog: DataFrame,
                  material_lots: DataFrame, batch_materials: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Batch x recipe line with the FEFO lot, actual = round(required x factor, 4).

    ``recipe`` is keyed by ``product_id`` (a bill of materials per product):
    batches join it on their product -- an equi-join, not the reference's
    cross join of one batch set with one formula, so work grows with the
    recipes actually used.  ``factors`` maps batch status to the tolerance
    factor (missing status -> actual NULL, weighing pending).  Lines whose
    (batch, material) already exists are skipped (NOT EXISTS): a batch brings
    the materials it has along, so the expanded lines, many times the input,
    leave the join on the product without another shuffle.
    """
    lot = fefo_lot_choice(material_catalog, material_lots)
    mats = materials.select("material_id", "material_code")
    bill = (recipe.select("product_id", "material_code", "required_quantity", "unit_of_measure")
            .join(mats, "material_code")
            .join(lot.select("material_code", "supply_material_id", "material_lot_id", "internal_lot_number"),
                  "material_code"))
    existing = batch_materials.groupBy("batch_id").agg(F.collect_set("material_id").alias("_has"))
    b = (batches.select("batch_id", "product_id", C("status").alias("_status"))
         .join(existing, "batch_id", "left"))
    lines = b.join(bill, "product_id").where(~F.coalesce(F.array_contains("_has", C("material_id")), F.lit(False)))
    fmap = F.create_map(*[x for k, v in factors.items() for x in (F.lit(k), F.lit(str(v)))])
    factor = F.element_at(fmap, C("_status")).cast("decimal(10,4)")
    actual = F.round(C("required_quantity") * factor, 4).cast("decimal(18,4)")
    return lines.select(
        "batch_id", "material_id", C("internal_lot_number").alias("material_lot"), "required_quantity",
        actual.alias("actual_quantity"), "unit_of_measure",
        F.when(factor.isNotNull(), "verified").otherwise("pending").alias("weighing_status"),
        "supply_material_id", C("material_lot_id").alias("supply_material_lot_id"))


__all__ = ["fefo_lot_choice", "lateral_top1", "first_numeric_key", "recipe_expand"]
