"""Telemetry queries (V19-V21) with oracles."""

from __future__ import annotations

from keelson.functions.rounding import sql_round_half_up as rh
from keelson.operators import telemetry
from keelson.plans.registry import query

METRICS_SQL = """
SELECT t.reading_id, t.asset_id, a.asset_name, t.recorded_at, a.phases, a.voltage_v, t.power_factor,
       t.real_power_kw,
       CASE WHEN a.phases = 3 THEN t.real_power_kw * 1000.0 / (sqrt(3.0) * a.voltage_v * greatest(t.power_factor, 0.1))
            ELSE t.real_power_kw * 1000.0 / (a.voltage_v * greatest(t.power_factor, 0.1)) END AS current_a,
       t.real_power_kw / greatest(t.power_factor, 0.1) AS apparent_power_kva,
       a.rated_current_a, t.equipment_temperature_c,
       greatest(0.0, least(100.0, t.health_pct)) AS health_pct, t.fault_code
FROM telemetry_readings t JOIN assets a ON a.asset_id = t.asset_id
"""

METRICS_FULL_SQL = f"""
SELECT m.* EXCLUDE (rated_current_a),
       sqrt(greatest(m.apparent_power_kva * m.apparent_power_kva - m.real_power_kw * m.real_power_kw, 0.0))
           AS reactive_power_kvar,
       100.0 * m.current_a / greatest(m.rated_current_a * 1.25, 1.0) AS breaker_utilization_pct,
       m.real_power_kw * 1.0 / 60.0 AS energy_kwh
FROM ({METRICS_SQL}) m
"""

_TITLE = ("array_to_string(list_transform(string_split(lower(replace(fault_code, '_', ' ')), ' '), "
          "lambda w: upper(w[1]) || w[2:]), ' ')")


def metrics(r):
    return telemetry.electrical_metrics(r.telemetry_readings, r.assets)


@query("electrical_metrics", METRICS_FULL_SQL)
def q_electrical_metrics(r):
    """V19 electrical quantities per reading."""
    return metrics(r)


@query("classify_alerts", f"""
SELECT reading_id, asset_id, recorded_at,
       CASE WHEN fault_code IS NOT NULL THEN 'HIGH' WHEN breaker_utilization_pct >= 100 THEN 'CRITICAL'
            ELSE 'HIGH' END AS severity,
       COALESCE(fault_code, 'POWER_THRESHOLD') AS alert_code, 'OPEN' AS status,
       CASE WHEN fault_code IS NOT NULL THEN asset_name || ': ' || {_TITLE}
            WHEN breaker_utilization_pct >= 100 THEN 'Breaker overload risk: ' || asset_name
            ELSE 'High equipment temperature: ' || asset_name END AS title,
       printf('Power %.1f kW; current %.1f A; temperature %.1f C.', {rh('real_power_kw', 1)},
              {rh('current_a', 1)}, {rh('equipment_temperature_c', 1)}) AS message,
       breaker_utilization_pct, fault_code
FROM ({METRICS_FULL_SQL}) m
WHERE fault_code IS NOT NULL OR breaker_utilization_pct >= 100 OR equipment_temperature_c >= 82
""")
def q_classify_alerts(r):
    """V20 alert rules over every reading."""
    return telemetry.classify_alerts(metrics(r))


GRID_SQL = f"""
SELECT time_bucket(INTERVAL 1 HOUR, recorded_at) AS tick_start,
       time_bucket(INTERVAL 1 HOUR, recorded_at) + INTERVAL 1 HOUR AS tick_end,
       COUNT(*) AS asset_count,
       CAST(round(SUM(CAST(real_power_kw AS DECIMAL(18,4))), 3) AS DOUBLE) AS total_load_kw,
       COUNT(fault_code) AS fault_count,
       COALESCE({rh('max(breaker_utilization_pct)', 3)}, 0.0) AS max_breaker_utilization_pct
FROM ({METRICS_FULL_SQL}) m
GROUP BY 1, 2
"""


@query("grid_snapshot", GRID_SQL)
def q_grid_snapshot(r):
    """V21 hourly grid snapshot (tumbling window)."""
    return telemetry.grid_snapshot(metrics(r))
