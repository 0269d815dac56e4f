"""Admin and registry reports (Q1-Q6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col

# Request statuses counted as open / pending review / closed (lower case).
OPEN_REQUEST_STATUSES = ["requested", "pending admin reconciliation", "approved"]
PENDING_REVIEW_STATUSES = ["requested", "pending admin reconciliation"]
CLOSED_REQUEST_STATUSES = ["completed", "rejected"]
# The key names the pre-push secret check looks for (any prefix on the ingest key).
SECRET_KEY_NAMES = ["[A-Z0-9_]*INGEST_API_KEY", "OPENAI_API_KEY", "DATABASE_URL", "MONGODB_URL"]


def session_overview(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Q1: sessions, active sessions, open and pending reset requests -- one row."""
    s = sessions.agg(F.count(F.lit(1)).alias("sessions"),
                     F.count_if(F.lower("status") == "active").alias("active_sessions"))
    r = requests.agg(F.count_if(F.lower("status").isin(OPEN_REQUEST_STATUSES)).alias("reset_requests"),
                     F.count_if(F.lower("status").isin(PENDING_REVIEW_STATUSES)).alias("pending_reset_requests"))
    return s.crossJoin(r)  # one row x one row


def session_entities(sessions: DataFrame, entities: DataFrame, limit: int | None = None) -> DataFrame:
    """Q2: per session the active entity count and the ordered ``type:id`` list (NULL when none).

    Entities are aggregated per session before the join; the list is the
    sorted collection of (type, id) pairs, so it does not depend on row order.
    """
    e = entities.groupBy("session_id").agg(
        F.count_if(C("active") & C("entity_id").isNotNull()).alias("active_entities"),
        F.sort_array(F.collect_list(F.when(C("active"), F.struct("entity_type", "entity_id",
                                                                 F.concat(C("entity_type"), F.lit(":"),
                                                                          C("entity_id")).alias("label")))))
        .alias("_items"))
    listed = F.array_join(F.transform(C("_items"), lambda x: x["label"]), ", ")
    j = sessions.select("session_id", "status", "created_at", "last_seen_at").join(e, "session_id", "left")
    out = j.select("session_id", "status", "created_at", "last_seen_at",
                   F.coalesce(C("active_entities"), F.lit(0)).cast("long").alias("active_entities"),
                   F.when(F.size(C("_items")) > 0, listed).alias("entities"))
    if limit is None:
        return out
    return out.orderBy(C("last_seen_at").desc_nulls_first(), C("session_id").asc()).limit(limit)


def request_history(requests: DataFrame, closed: bool = True, limit: int | None = None) -> DataFrame:
    """Q3: closed (completed/rejected) or open requests; with a ``limit`` the newest by
    COALESCE(completed_at, requested_at)."""
    cond = F.lower("status").isin(CLOSED_REQUEST_STATUSES)
    rows = requests.where(cond if closed else ~cond)
    cols = [c for c in ["request_id", "session_id", "operator", "reason", "status", "requested_at", "completed_at",
                        "admin_note", "reviewed_by", "reviewed_at"] if c in requests.columns]
    if limit is None:
        return rows.select(*cols)
    return (rows.select(*cols)
            .orderBy(F.coalesce(C("completed_at"), C("requested_at")).desc_nulls_first(), C("request_id").asc())
            .limit(limit))


def baseline_status(baselines: dict[str, DataFrame], sessions: DataFrame) -> DataFrame:
    """Q4: row count per baseline plus ``safe`` (no active session) on every row."""
    active = sessions.agg(F.count_if(F.lower("status") == "active").alias("_active"))
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("baseline_name"), "row_count")
             for n, df in baselines.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.crossJoin(active).select("baseline_name", "row_count", (C("_active") == 0).alias("safe"))


def registry_overview(systems: DataFrame, datasets: DataFrame, relationships: DataFrame) -> DataFrame:
    """Q5: systems, datasets, relationships, active systems, active datasets -- one row."""
    s = systems.agg(F.count(F.lit(1)).alias("systems"), F.count_if(C("status") == "active").alias("active_systems"))
    d = datasets.agg(F.count(F.lit(1)).alias("datasets"), F.count_if(C("is_active")).alias("active_datasets"))
    r = relationships.agg(F.count(F.lit(1)).alias("relationships"))
    return s.crossJoin(d).crossJoin(r).select("systems", "datasets", "relationships", "active_systems",
                                              "active_datasets")


def secret_pattern(key_names: Sequence[str] = SECRET_KEY_NAMES, spaced: bool = False) -> str:
    sep = " ?= ?" if spaced else "="
    return "(" + "|".join(key_names) + ")" + sep + ".{8,}"


def secret_lines(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Q6 detail: every line (whole text, split on newlines) matching the assignment pattern."""
    lines = docs.select(id_col, "source", F.posexplode(F.split(C(text_col), "\n")).alias("line_no", "line"))
    return lines.where(C("line").rlike(pattern))


def secret_scan(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Q6: per source, matching lines and documents."""
    hits = secret_lines(docs, pattern, id_col, text_col)
    return hits.groupBy("source").agg(F.count(F.lit(1)).alias("matching_lines"),
                                      F.count_distinct(id_col).alias("documents"))
