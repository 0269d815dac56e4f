"""Electrical telemetry operators (V19-V21): formulas, alert rules, tick roll-up.

Re-aimed from the reference's asset simulator: the random draws are replaced
by readings from a table; the derived quantities and the alert rules are the
same.  All of it is built-in column arithmetic, so the same functions work on
batch and streaming DataFrames.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.rounding import round_half_up

C = F.col
SQRT3 = math.sqrt(3.0)


def electrical_metrics(readings: DataFrame, assets: DataFrame, minutes: float = 1.0) -> DataFrame:
    """Current, apparent/reactive power, breaker use and energy per reading."""
    j = readings.join(assets.select("asset_id", "asset_name", "phases", "voltage_v", "rated_current_a"),
                      "asset_id")
    pf = F.greatest(C("power_factor"), F.lit(0.1))
    p = C("real_power_kw")
    current = F.when(C("phases") == 3, p * 1000.0 / (F.lit(SQRT3) * C("voltage_v") * pf)) \
               .otherwise(p * 1000.0 / (C("voltage_v") * pf))
    apparent = p / pf
    out = j.select(
        "reading_id", "asset_id", "asset_name", "recorded_at", "phases", "voltage_v", "power_factor",
        "real_power_kw", current.alias("current_a"), apparent.alias("apparent_power_kva"),
        "rated_current_a", "equipment_temperature_c",
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), C("health_pct"))).alias("health_pct"), "fault_code")
    out = out.withColumn("reactive_power_kvar",
                         F.sqrt(F.greatest(C("apparent_power_kva") * C("apparent_power_kva") - p * p, F.lit(0.0))))
    out = out.withColumn("breaker_utilization_pct",
                         F.lit(100.0) * C("current_a") / F.greatest(C("rated_current_a") * 1.25, F.lit(1.0)))
    out = out.withColumn("energy_kwh", p * F.lit(float(minutes)) / F.lit(60.0))
    return out.drop("rated_current_a")


def _title_case(c):
    return F.initcap(F.regexp_replace(c, "_", " "))


def classify_alerts(metrics: DataFrame) -> DataFrame:
    """First matching rule wins -- fault code, breaker >= 100, temperature >= 82."""
    fault, brk, temp = C("fault_code"), C("breaker_utilization_pct"), C("equipment_temperature_c")
    severity = (F.when(fault.isNotNull(), "HIGH").when(brk >= 100, "CRITICAL").when(temp >= 82, "HIGH"))
    title = (F.when(fault.isNotNull(), F.concat(C("asset_name"), F.lit(": "), _title_case(fault)))
             .when(brk >= 100, F.concat(F.lit("Breaker overload risk: "), C("asset_name")))
             .when(temp >= 82, F.concat(F.lit("High equipment temperature: "), C("asset_name"))))
    message = F.format_string("Power %.1f kW; current %.1f A; temperature %.1f C.",
                              round_half_up(C("real_power_kw"), 1), round_half_up(C("current_a"), 1),
                              round_half_up(temp, 1))
    return (metrics.withColumn("severity", severity).where(C("severity").isNotNull())
            .select("reading_id", "asset_id", "recorded_at", "severity",
                    F.coalesce(fault, F.lit("POWER_THRESHOLD")).alias("alert_code"),
                    F.lit("OPEN").alias("status"), title.alias("title"), message.alias("message"),
                    "breaker_utilization_pct", "fault_code"))


def grid_snapshot(metrics: DataFrame, tick: str = "1 hour") -> DataFrame:
    """Per tick (tumbling window on ``recorded_at``) asset count, load, faults, max breaker use.

    Power is summed as DECIMAL so the total does not depend on row order.
    """
    g = metrics.groupBy(F.window("recorded_at", tick).alias("tick")).agg(
        F.count(F.lit(1)).alias("asset_count"),
        F.sum(C("real_power_kw").cast("decimal(18,4)")).alias("_load"),
        F.count("fault_code").alias("fault_count"),
        F.max("breaker_utilization_pct").alias("_brk"))
    return g.select(
        C("tick.start").cast("timestamp_ntz").alias("tick_start"), C("tick.end").cast("timestamp_ntz").alias("tick_end"),
        "asset_count",
        F.round(C("_load"), 3).cast("double").alias("total_load_kw"), "fault_count",
        F.coalesce(round_half_up(C("_brk"), 3), F.lit(0.0)).alias("max_breaker_utilization_pct"))
