"""Event ingest (E1-E10): validate, resolve the system, normalise time, check keys,
build the envelope and route by type.

The same column expressions serve batch DataFrames and Structured Streaming
(see ``keelson.streaming.events``).  Where the reference stops a request at
the first bad event (earlier ones already stored), this splits each batch
into accepted and rejected rows with a reason.

Input frame (one row per posted event): ``source_event_id``, ``batch_id``,
``batch_system_key``, ``batch_system_id``, ``raw_type``, ``system_key``,
``system_id``, ``timestamp_text``, ``body`` (JSON object text).
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from keelson.functions.time import iso_timestamp

C = F.col

# Event type -> collection, identity pattern and limits as in the reference.
COLLECTION_BY_EVENT_TYPE = {
    "telemetry": "telemetry_events",
    "alert": "alert_events",
    "diagnostic": "diagnostic_payloads",
    "snapshot": "simulation_snapshots",
    "log": "application_logs",
    "ai_interaction": "ai_interactions",
}
SAFE_KEY = r"^[A-Za-z0-9_.:-]+$"
# Text fields that must not be empty, fields that must be there, and fields that hold objects, by type.
REQUIRED_TEXT = {
    "telemetry": ["metric"],
    "alert": ["severity", "message"],
    "diagnostic": ["diagnostic_type"],
    "log": ["level", "message"],
    "ai_interaction": ["role", "content"],
}
REQUIRED_ANY = {"telemetry": ["value"]}
OBJECT_FIELDS = {"diagnostic": ["payload"], "snapshot": ["state"], "ai_interaction": ["context"]}
OBJECT_FIELDS_OF_ALL = ["tags"]


BODY_FIELDS = sorted({"system_key", "system_id", "asset_id", "source", "environment", "correlation_id", "event_type",
                      "system_name"} | {n for fs in REQUIRED_TEXT.values() for n in fs})
# Every known field read as text (objects/numbers keep their JSON text): the
# body is parsed once per row instead of once per field.
BODY_SCHEMA = StructType([StructField(n, StringType()) for n in BODY_FIELDS])


def parsed_body() -> Column:
    return F.from_json(C("body"), BODY_SCHEMA)


def _field(name: str, parsed: Column | None = None) -> Column:
    if parsed is not None and name in BODY_FIELDS:
        return parsed[name]
    return F.get_json_object(C("body"), f"$.{name}")


def event_type(raw: Column) -> Column:
    """E6 helper: strip an ``EventType.`` prefix."""
    return F.regexp_replace(raw, r"^EventType\.", "")


def _kind(doc: Column, path: str) -> Column:
    """Type text of a value inside a VARIANT; NULL where there is none."""
    return F.schema_of_variant(F.try_variant_get(doc, path, "variant"))


def validate_events(df: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """The body is a JSON object with its type's required and object fields -> ``reject_reason`` (NULL = valid).

    ``limits`` maps field names to the most characters a deployment accepts;
    by default texts of any length pass.
    """
    df = df.withColumn("event_type", event_type(C("raw_type"))).withColumn("_body", parsed_body()) \
        .withColumn("_doc", F.try_parse_json(C("body")))
    t, body, doc = C("event_type"), C("_body"), C("_doc")
    checks = [(~F.coalesce(_kind(doc, "$").startswith("OBJECT"), F.lit(False)), "body must be a JSON object.")]
    for name, most in (limits or {}).items():
        checks.append((F.length(F.get_json_object("body", f"$.{name}")) > most, f"{name} is longer than {most} characters."))
    for typ, fields in REQUIRED_TEXT.items():
        for name in fields:
            v = _field(name, body)
            checks.append(((t == typ) & (v.isNull() | (v == "")), f"{typ}: {name} is required."))
    for typ, fields in REQUIRED_ANY.items():
        for name in fields:
            checks.append(((t == typ) & _kind(doc, f"$.{name}").isNull(), f"{typ}: {name} is required."))
    for typ, fields in [(None, OBJECT_FIELDS_OF_ALL), *OBJECT_FIELDS.items()]:
        for name in fields:
            kind = _kind(doc, f"$.{name}")
            checks.append(((F.lit(True) if typ is None else t == typ) & ~kind.startswith("OBJECT"),
                           f"{name} must be an object."))
    reason = F.lit(None).cast("string")
    for cond, msg in reversed(checks):
        reason = F.when(F.coalesce(cond, F.lit(False)), F.lit(msg)).otherwise(reason)
    return df.withColumn("reject_reason", reason).drop("_body", "_doc")


def safe_identity(c: Column) -> Column:
    """Trimmed identity, blank -> NULL."""
    v = F.trim(c)
    return F.when(F.length(v) > 0, v)


def identity_ok(c: Column) -> Column:
    return c.isNull() | ((F.length(c) <= 200) & c.rlike(SAFE_KEY))


def resolve_system(df: DataFrame, systems: DataFrame, strict: bool = True) -> DataFrame:
    """Canonical system identity for each event.

    The event's own key/id (else the request's) is matched against the
    registry by key or id, either way round, never as one OR join (that would
    be a nested loop).  The registry is reduced to two lookups with one row
    per value -- for probing with a key (key=key before id=key) and with an
    id (id=id before key=id) -- so each event takes two equi-joins that can
    never fan out; AQE broadcasts the lookups when they are small.
    First match wins: key=key, id=key, id=id, key=id.  Adds
    ``system_id``, ``system_key``, ``system_name``, ``registry_validated`` and
    sets ``reject_reason`` for invalid identities and, when ``strict``, for
    unknown systems.
    """
    own_key = safe_identity(F.coalesce(C("system_key"), C("batch_system_key")))
    own_id = safe_identity(F.coalesce(C("system_id"), C("batch_system_id")))
    ev = df.withColumn("_key", own_key).withColumn("_id", own_id)
    sysrow = F.struct(C("system_id").cast("string").alias("id"), C("system_key").cast("string").alias("key"),
                      C("system_name").cast("string").alias("name"))
    by_key = systems.select(C("system_key").cast("string").alias("_v"), sysrow.alias("_s"))
    by_id = systems.select(C("system_id").cast("string").alias("_v"), sysrow.alias("_s"))

    def lookup(first, second, n):
        # one row per probe value: the first-priority match, else the second
        rows = (first.withColumn("_rank", F.lit(1)).unionByName(second.withColumn("_rank", F.lit(2)))
                .where(C("_v").isNotNull()))
        best = rows.groupBy("_v").agg(F.min(F.struct("_rank", "_s")).alias("_b"))
        return best.select(C("_v").alias(f"_p{n}"), C("_b._s").alias(f"_m{n}"))

    # Events without a key (or id) get a probe value no registry can hold, spread by their body:
    # as NULLs they would all meet in one task of a shuffled join.
    spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("body", "source_event_id"), F.lit(4096)).cast("string"))
    ev = (ev.join(lookup(by_key, by_id, 1), F.coalesce(C("_key"), spread) == C("_p1"), "left").drop("_p1")   # key=key, id=key
          .join(lookup(by_id, by_key, 2), F.coalesce(C("_id"), spread) == C("_p2"), "left").drop("_p2"))     # id=id, key=id
    match = F.coalesce(C("_m1"), C("_m2"))
    valid_ident = identity_ok(C("_key")) & identity_ok(C("_id"))
    has_ident = C("_key").isNotNull() | C("_id").isNotNull()
    found = match.isNotNull()
    ev = ev.withColumn("_match", match)
    res_id = F.coalesce(C("_match.id"), C("_id"))
    res_key = F.when(found, F.coalesce(C("_match.key"), F.coalesce(C("_key"), res_id))).otherwise(
        F.coalesce(C("_key"), C("_id")))
    res_name = F.when(found, F.coalesce(C("_match.name"), res_key)).otherwise(F.coalesce(C("_key"), C("_id")))
    reason = (F.when(~valid_ident, F.lit("Invalid system identifier."))
              .when(~has_ident, F.lit("system_key or system_id is required.")))
    if strict:
        reason = reason.when(~found, F.lit("System is not registered."))
    prior = C("reject_reason") if "reject_reason" in df.columns else F.lit(None).cast("string")
    out = (ev.withColumn("system_id", F.when(found, C("_match.id")).otherwise(C("_id")))
           .withColumn("system_key", res_key).withColumn("system_name", res_name)
           .withColumn("registry_validated", found)
           .withColumn("reject_reason", F.coalesce(prior, reason)))
    return out.drop("_key", "_id", "_match", "_m1", "_m2")


def normalize_ts(df: DataFrame, now: Column) -> DataFrame:
    """ISO-8601 text -> UTC timestamp (``Z``/offsets honoured, naive = UTC, missing -> ``now``).

    A bare time or year is not a timestamp and is rejected.
    """
    parsed = iso_timestamp(C("timestamp_text"))
    ts = F.when(C("timestamp_text").isNull(), now).otherwise(parsed)
    bad = C("timestamp_text").isNotNull() & parsed.isNull()
    prior = C("reject_reason") if "reject_reason" in df.columns else F.lit(None).cast("string")
    return (df.withColumn("timestamp", ts)
            .withColumn("reject_reason", F.coalesce(prior, F.when(bad, F.lit("timestamp must be a valid ISO-8601 datetime.")))))


def _first_bad_key(text: str | None, root: str = "payload") -> str | None:
    """First invalid key in document order (pre-order walk, as the reference recurses)."""
    if text is None:
        return None
    try:
        doc = json.loads(text)
    except ValueError:
        return "payload is not valid JSON."
    stack = [("val", doc, root)]
    while stack:
        kind, value, path = stack.pop()
        if kind == "key":
            if value.startswith("$") or "." in value:
                return f"Invalid field name '{value}' in {path}."
        elif isinstance(value, dict):
            tasks = []
            for key, child in value.items():
                tasks.append(("key", key, path))
                tasks.append(("val", child, f"{path}.{key}"))
            stack.extend(reversed(tasks))
        elif isinstance(value, list):
            stack.extend(reversed([("val", c, f"{path}[{i}]") for i, c in enumerate(value)]))
    return None


@F.pandas_udf(StringType())
def first_bad_key(texts: pd.Series) -> pd.Series:
    """E4 helper (Arrow batches): first key starting with '$' or containing '.', depth-first, with path."""
    return texts.map(_first_bad_key)


# A quote-free run between two quote characters that holds '$' or '.'.  Any
# string literal containing such a character yields a match (the nearest quote
# characters around it bound one), so no invalid key is missed; the pattern is
# plain character-class loops (no nested alternation for the JVM engine to
# recurse on in long texts).  Other rows skip the Python walk.
MAYBE_BAD_KEY = r'"[^"]*[$.][^"]*"'


def validate_keys(df: DataFrame) -> DataFrame:
    """Reject bodies with a key that starts with '$' or contains '.', at any depth.

    A JVM-side regex finds the bodies that could hold such a key; only those
    reach the Arrow-batched Python walk (the rest pass NULL, so nothing is
    parsed or copied for them).
    """
    prior = C("reject_reason") if "reject_reason" in df.columns else F.lit(None).cast("string")
    # an escape can spell any character, so a body with a backslash is walked too
    candidate = F.when(C("body").rlike(MAYBE_BAD_KEY) | C("body").contains("\\"), C("body"))
    return df.withColumn("reject_reason", F.coalesce(prior, first_bad_key(candidate)))


def route_events(df: DataFrame) -> DataFrame:
    """Target collection per type; unknown types rejected."""
    m = F.create_map(*[F.lit(x) for kv in COLLECTION_BY_EVENT_TYPE.items() for x in kv])
    t = C("event_type") if "event_type" in df.columns else event_type(C("raw_type"))
    coll = F.element_at(m, t)
    prior = C("reject_reason") if "reject_reason" in df.columns else F.lit(None).cast("string")
    return (df.withColumn("event_type", t).withColumn("collection", coll)
            .withColumn("reject_reason", F.coalesce(prior, F.when(coll.isNull(), F.concat(
                F.lit("Unsupported event type '"), t, F.lit("'."))))))


ENVELOPE_STRING_FIELDS = ["event_type", "system_id", "system_key", "system_name"]


def envelope(df: DataFrame, received_at: Column) -> DataFrame:
    """E5: stored document columns; body fields win over envelope fields of the same name.

    ``event_id`` is a content hash (source id, type, body) so a retried post
    gets the same id, unlike the reference's random id.  The body stays as
    JSON text in ``payload`` with the reserved identity/time keys removed.
    """
    eid = F.sha2(F.concat_ws("|", C("source_event_id").cast("string"), C("event_type"), C("body")), 256)
    out = df.withColumn("event_id", eid).withColumn("received_at", received_at).withColumn("_body", parsed_body())
    for name in ENVELOPE_STRING_FIELDS:
        out = out.withColumn(name, F.coalesce(_field(name, C("_body")), C(name)))
    out = out.drop("_body")
    m = F.from_json(C("body"), "map<string,variant>")  # VARIANT keeps each value's JSON type
    payload = F.map_filter(m, lambda k, v: ~k.isin("system_key", "system_id", "timestamp"))
    return out.withColumn("payload", F.to_json(payload))


def ingest(df: DataFrame, systems: DataFrame, now: Column, strict: bool = True,
           limits: dict[str, int] | None = None) -> DataFrame:
    """E7 core: E1-E6 in order; every row carries ``reject_reason`` (NULL = accepted).

    Requests of any size are taken; each event is judged on its own.
    """
    x = route_events(validate_events(df, limits))
    x = resolve_system(x, systems, strict)
    x = normalize_ts(x, now)
    x = validate_keys(x)
    return envelope(x, now)


def ingest_batch(df: DataFrame, systems: DataFrame, now: Column, strict: bool = True) -> DataFrame:
    """Per request, events read / accepted / rejected."""
    x = ingest(df, systems, now, strict)
    return x.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(C("reject_reason").isNull()).alias("accepted"),
        F.count_if(C("reject_reason").isNotNull()).alias("rejected"))


# ------------------------------------------------------------ E9 / E10
def _event_time(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    """Watermarks need instant time: wall-clock (NTZ, UTC) columns are cast first."""
    if not watermark:
        return df
    return df.withColumn(ts, C(ts).cast("timestamp")).withWatermark(ts, watermark)


def windowed_rollup(df: DataFrame, ts: str, keys: list[str], value: str, window: str,
                    slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Tumbling (or sliding) window counts and DECIMAL sums per key; same code for streams."""
    df = _event_time(df, ts, watermark)
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    g = df.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("events"),
                                            F.sum(C(value).cast("decimal(18,4)")).alias("value_sum"),
                                            F.max(value).alias("value_max"))
    return g.select(C("w.start").cast("timestamp_ntz").alias("window_start"),
                    C("w.end").cast("timestamp_ntz").alias("window_end"), *keys, "events",
                    C("value_sum").cast("double").alias("value_sum"), "value_max")


def session_rollup(df: DataFrame, ts: str, keys: list[str], value: str, gap: str,
                   watermark: str | None = None, chunk: str | None = "day") -> DataFrame:
    """Session windows (inactivity ``gap``) per key: start, end (last event + gap), count, sum.

    Batch form (``chunk`` = a ``date_trunc`` unit): sessions are first built
    inside (key, time chunk) groups, so one key holding a third of all events is spread over
    as many tasks as it has chunks; partial sessions that overlap across a
    chunk boundary (next start < previous end) are then merged -- the same
    sessions as one pass over the key, exactly.  Streaming form
    (``watermark`` set, or ``chunk=None``): Spark's ``session_window`` state.
    """
    if watermark or not chunk:
        df = _event_time(df, ts, watermark)
        g = df.groupBy(F.session_window(ts, gap).alias("s"), *keys).agg(
            F.count(F.lit(1)).alias("events"), F.sum(C(value).cast("decimal(18,4)")).alias("value_sum"))
        return g.select(C("s.start").cast("timestamp_ntz").alias("session_start"),
                        C("s.end").cast("timestamp_ntz").alias("session_end"), *keys, "events",
                        C("value_sum").cast("double").alias("value_sum"))
    part = (df.groupBy(*keys, F.date_trunc(chunk, ts).alias("_chunk"), F.session_window(ts, gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("_n"), F.sum(C(value).cast("decimal(18,4)")).alias("_v"))
            .select(*keys, C("s.start").cast("timestamp_ntz").alias("_s"), C("s.end").cast("timestamp_ntz").alias("_e"),
                    "_n", "_v"))
    w = Window.partitionBy(*keys).orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    starts = part.withColumn("_new", F.coalesce(C("_s") >= F.max("_e").over(w), F.lit(True)).cast("int"))
    grouped = starts.withColumn("_grp", F.sum("_new").over(
        Window.partitionBy(*keys).orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, 0)))
    out = grouped.groupBy(*keys, "_grp").agg(F.min("_s").alias("session_start"), F.max("_e").alias("session_end"),
                                            F.sum("_n").alias("events"), F.sum("_v").alias("_v"))
    return out.select("session_start", "session_end", *keys, "events", C("_v").cast("double").alias("value_sum"))


def dedupe_events(df: DataFrame, keys: list[str], ts: str, order_col: str, window: str = "1 hour") -> DataFrame:
    """One event per content key and clock ``window``, here the earliest.

    The same definition holds for streams (``streaming.events.dedupe_stream``):
    which windows a key has does not depend on how events arrive, so batch and
    stream keep the same (key, window) pairs.  ``min(struct(ts, order_col, ...))``
    is a partial aggregate, so a hot key is reduced map-side.
    """
    others = [c for c in df.columns if c not in keys and c not in (ts, order_col)]
    bucket = F.window(ts, window).start.alias("_bucket")
    g = df.groupBy(*keys, bucket).agg(F.min(F.struct(ts, order_col, *others)).alias("_first"))
    return g.select(*keys, "_first.*")
