"""Chart (G1-G5, W3) and catalog (K3-K9) queries with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import catalog, charts, selection
from keelson.operators.events import COLLECTION_BY_EVENT_TYPE
from keelson.plans.registry import query

C = F.col
CUTOFF = "2024-01-16 00:00:00"
LINEAGE_CUTOFF = "2024-01-04 00:00:00"


def event_rows(r):
    """All events with a numeric-or-not y text."""
    e = r.table("events")
    y = F.when(C("event_type") == "error", F.lit("n/a")).otherwise(F.get_json_object("props", "$.k"))
    return e.select("event_id", "ts", "event_type", y.alias("y"))


def results(r):
    """Aggregation result to plot: per day and event type the sum of k over all events, as text."""
    e = event_rows(r).withColumn("day", F.to_date("ts"))
    total = F.sum(F.expr("try_cast(y as bigint)")).cast("string")
    return e.groupBy("day", "event_type").agg(F.coalesce(total, F.lit("n/a")).alias("y"))


RES_SQL = """SELECT CAST(ts AS DATE) AS day, event_type,
       CASE WHEN event_type = 'error' THEN 'n/a'
            ELSE coalesce(CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS VARCHAR), 'n/a') END AS y
FROM events GROUP BY 1, 2"""
POINTS_SQL = f"""
SELECT position, COALESCE(event_type, CAST(position AS VARCHAR)) AS label, v AS value FROM (
  SELECT *, row_number() OVER (ORDER BY day, event_type) AS position, TRY_CAST(trim(y) AS DOUBLE) AS v FROM ({RES_SQL}) a) p
WHERE v IS NOT NULL AND isfinite(v)
"""


def points(r):
    return charts.chart_points(results(r), "event_type", "y", [C("day"), C("event_type")])


@query("chart_points", POINTS_SQL)
def q_chart_points(r):
    """G1 the numeric points of an aggregated result, all of them."""
    return points(r)


@query("chart_scale", f"""
WITH p AS ({POINTS_SQL}), s AS (SELECT least(0.0, min(value)) AS min_value, max(value) AS max_value FROM p)
SELECT position, label, value, min_value, max_value,
       CASE WHEN max_value - min_value = 0 THEN 1.0 ELSE max_value - min_value END AS span,
       288.0 - (value - min_value) / (CASE WHEN max_value - min_value = 0 THEN 1.0 ELSE max_value - min_value END)
             * 246.0 AS y
FROM p, s
""")
def q_chart_scale(r):
    """G2 axis range and scaled y per point."""
    return charts.chart_scale(points(r))


@query("pie_shares", f"""
WITH p AS (SELECT * FROM ({POINTS_SQL}) x WHERE value > 0), t AS (SELECT sum(value) AS total FROM p)
SELECT position, label, value, value / total AS fraction,
       COALESCE(SUM(value) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) / total
           AS "offset"
FROM p, t
""")
def q_pie_shares(r):
    """G3 positive slices with fraction and running offset."""
    return charts.pie_shares(points(r))


@query("result_keys", """
SELECT DISTINCT unnest(json_keys(body)) AS key FROM ingest_events
""")
def q_result_keys(r):
    """G4 field names found in the result documents."""
    return charts.result_keys(r.ingest_events, "body")


@query("first_numeric_key", f"""
SELECT CASE WHEN max(TRY_CAST(CAST(event_id AS VARCHAR) AS DOUBLE)) IS NOT NULL THEN 'event_id'
            WHEN max(TRY_CAST(CAST(ts AS VARCHAR) AS DOUBLE)) IS NOT NULL THEN 'ts'
            WHEN max(TRY_CAST(event_type AS DOUBLE)) IS NOT NULL THEN 'event_type'
            WHEN max(TRY_CAST(y AS DOUBLE)) IS NOT NULL THEN 'y' END AS first_numeric_key
FROM (SELECT event_id, ts, event_type, json_extract_string(props, '$.k') AS y FROM events) b
""")
def q_first_numeric_key(r):
    """W3 first column holding a number, over all rows."""
    return selection.first_numeric_key(event_rows(r))


_COLL = ("map {'telemetry': 'telemetry_events', 'alert': 'alert_events', 'diagnostic': 'diagnostic_payloads', "
         "'snapshot': 'simulation_snapshots', 'log': 'application_logs', 'ai_interaction': 'ai_interactions'}[t]")
_TYPE_OF = ("CASE event_type WHEN 'error' THEN 'alert' WHEN 'click' THEN 'telemetry' WHEN 'view' THEN 'log' "
            "WHEN 'signup' THEN 'snapshot' ELSE 'ai_interaction' END")


def saved_charts(r):
    m = F.create_map(*[F.lit(x) for kv in COLLECTION_BY_EVENT_TYPE.items() for x in kv])
    g = r.table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    t = F.expr(_TYPE_OF)
    return g.select(C("event_type").alias("chart_id"), F.lit("Operations Overview").alias("dashboard_name"),
                    F.element_at(m, t).alias("collection"),
                    F.when(C("event_type") == "signup", F.lit(None)).otherwise(F.concat(F.lit("sys-"), t))
                    .alias("system_key"),
                    C("n").alias("data_points"))


@query("dashboard_summary", f"""
WITH c AS (SELECT event_type AS chart_id, {_TYPE_OF} AS t, COUNT(*) AS data_points FROM events
           GROUP BY event_type),
c2 AS (SELECT chart_id, {_COLL} AS collection, CASE WHEN chart_id = 'signup' THEN NULL ELSE 'sys-' || t END AS system_key,
              data_points FROM c)
SELECT COUNT(*) AS charts, COUNT(DISTINCT collection) AS collections,
       COUNT(DISTINCT COALESCE(system_key, 'Unassigned')) AS systems, CAST(COALESCE(SUM(data_points), 0) AS BIGINT) AS data_points
FROM c2
""")
def q_dashboard_summary(r):
    """G5 dashboard chart, collection, system and data-point counts (all systems)."""
    return charts.dashboard_summary(saved_charts(r), "Operations Overview")


# ------------------------------------------------------------------ catalog
_ORDERS_TYPES = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                 ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@query("profile_table", "\nUNION ALL\n".join(
    f"SELECT 'orders' AS table_name, '{c}' AS column_name, '{t}' AS data_type, {i} AS ordinal, COUNT({c}) AS non_null, "
    f"COUNT(DISTINCT {c}) AS distinct_values, COUNT(*) AS row_count FROM orders"
    for i, (c, t) in enumerate(_ORDERS_TYPES)))
def q_profile_table(r):
    """K3 column profile of orders (exact distinct counts)."""
    return catalog.profile_table(r.table("orders"), "orders", exact_distinct=True)


@query("register_datasets", f"""
WITH old AS (SELECT DISTINCT user_id AS system_id, concat('events.', event_type) AS dataset_key FROM events
             WHERE ts < TIMESTAMP '{CUTOFF}')
SELECT d.dataset_id, d.system_id, d.dataset_key,
       CASE WHEN o.system_id IS NULL THEN 'created' ELSE 'updated' END AS action
FROM datasets d LEFT JOIN old o ON o.system_id = d.system_id AND o.dataset_key = d.dataset_key
""")
def q_register_datasets(r):
    """K5 created/updated per discovered dataset against the registry of the first half-month."""
    ev = r.table("events").where(C("ts") < F.lit(CUTOFF).cast("timestamp_ntz"))
    old = ev.select(C("user_id").alias("system_id"),
                    F.concat(F.lit("events."), C("event_type")).alias("dataset_key")).distinct()
    disc = r.datasets.select("dataset_id", "system_id", "dataset_key")
    return catalog.register_datasets(disc, old, update_existing=True)


def _edges(df):
    return df.select(F.concat(F.lit("sys-"), C("user_id").cast("string")).alias("source_system"),
                     F.lit("events.view").alias("source_dataset"),
                     F.concat(F.lit("sys-"), C("user_id").cast("string")).alias("target_system"),
                     F.lit("events.purchase").alias("target_dataset"),
                     F.lit("analytics-view").alias("transformation_type"))


@query("add_lineage", f"""
WITH cand AS (SELECT DISTINCT 'sys-' || CAST(user_id AS VARCHAR) AS source_system, 'events.view' AS source_dataset,
                     'sys-' || CAST(user_id AS VARCHAR) AS target_system, 'events.purchase' AS target_dataset,
                     'analytics-view' AS transformation_type FROM events WHERE event_type = 'purchase'),
old AS (SELECT DISTINCT 'sys-' || CAST(user_id AS VARCHAR) AS source_system FROM events
        WHERE event_type = 'purchase' AND ts < TIMESTAMP '{LINEAGE_CUTOFF}')
SELECT c.* FROM cand c WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.source_system = c.source_system)
""")
def q_add_lineage(r):
    """K7 lineage edges not yet recorded."""
    ev = r.table("events").where(C("event_type") == "purchase")
    existing = _edges(ev.where(C("ts") < F.lit(LINEAGE_CUTOFF).cast("timestamp_ntz"))).distinct()
    return catalog.add_lineage(existing, _edges(ev))


_LENS = ("CASE WHEN cast(get_json_object(props, '$.k') as int) = 1 THEN 'ghost' "
         "WHEN cast(get_json_object(props, '$.k') as int) % 2 = 0 THEN cast(user_id as string) "
         "ELSE concat('customer-', lpad(cast(user_id as string), 9, '0')) END")


@query("system_lens", """
WITH lens AS (SELECT DISTINCT CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) = 1 THEN 'ghost'
                     WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 THEN CAST(user_id AS VARCHAR)
                     ELSE concat('customer-', lpad(CAST(user_id AS VARCHAR), 9, '0')) END AS lens_value FROM events),
res AS (SELECT l.lens_value, COALESCE(a.system_id, b.system_id) AS system_id, COALESCE(a.system_key, b.system_key) AS system_key,
               COALESCE(a.system_name, b.system_name, l.lens_value) AS system_name
        FROM lens l LEFT JOIN systems a ON CAST(a.system_id AS VARCHAR) = l.lens_value
        LEFT JOIN systems b ON b.system_key = l.lens_value),
cnt AS (SELECT system_id, COUNT(*) AS n FROM datasets GROUP BY system_id)
SELECT res.lens_value, res.system_id, res.system_key, res.system_name, COALESCE(cnt.n, 0) AS datasets
FROM res LEFT JOIN cnt ON cnt.system_id = res.system_id
""")
def q_system_lens(r):
    """K9 lens values (id or key) resolved to systems with dataset counts."""
    lens = r.table("events").select(F.expr(_LENS).alias("lens_value")).distinct()
    return catalog.system_lens(lens, r.systems, r.datasets)
