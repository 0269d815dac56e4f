"""Set-based change application.

Parquet has no in-place UPDATE, so every operator returns the *new state* of
the table (the caller writes it to a new path, never over the input being
read).  Joins are arranged so the big table is shuffled once at most:

* keyed updates join the table to the change set (``left``): AQE broadcasts
  the change set when its measured size is small, else sort-merge;
* inserts test only the table's key column (``left_anti``).

Keys compare null-safely (two NULL key parts are the same key), and a change
set is reduced to one row per key before it meets the table, so applying it
never adds rows and applying it twice changes nothing more.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.session import cut_lineage

C = F.col


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def same_key(left: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of ``left``'s keys with the columns ``prefix + key``."""
    cond = F.lit(True)
    for c in keys:
        cond = cond & left[c].eqNullSafe(C(prefix + c))
    return cond


def absent(candidates: DataFrame, existing: DataFrame, key) -> DataFrame:
    """Rows of ``candidates`` whose key is not in ``existing`` (NOT EXISTS); NULL key parts match NULL."""
    k = _keys(key)
    keys = existing.select(*[C(c).alias(f"_has_{c}") for c in k])
    return candidates.join(keys, same_key(candidates, k, "_has_"), "left_anti")


def one_per_key(df: DataFrame, key) -> DataFrame:
    """One row per key: the smallest by its other columns, in their order."""
    k = _keys(key)
    others = [c for c in df.columns if c not in k]
    if not others:
        return df.dropDuplicates(k)
    return df.groupBy(*k).agg(F.min(F.struct(*others)).alias("_row")).select(*k, "_row.*").select(*df.columns)


def duplicate_keys(df: DataFrame, key) -> DataFrame:
    """Keys that occur more than once (the uniqueness check of C1/C7)."""
    k = _keys(key)
    return df.groupBy(*k).agg(F.count(F.lit(1)).alias("occurrences")).where(C("occurrences") > 1)


def upsert(target: DataFrame, source: DataFrame, key, update_cols: Sequence[str] | None = None,
           keep_first: Iterable[str] = (), check_unique: bool = True) -> DataFrame:
    """INSERT ... ON CONFLICT (key) DO UPDATE SET col = EXCLUDED.col.

    ``update_cols`` (default: every non-key column) take the source value when
    the key matches; ``keep_first`` columns keep an existing non-null value
    (``COALESCE(existing, new)``); other columns keep the target value.  New
    keys are inserted with the source row.  The source must be unique per key:
    this is verified first (one aggregate over the source) and raises, as the
    database does when a row would be updated twice.  ``check_unique=False``
    reduces it with ``one_per_key`` instead.
    """
    k = _keys(key)
    if not check_unique:
        source = one_per_key(source, k)
    elif not duplicate_keys(source, k).isEmpty():
        raise ValueError("upsert source has more than one row for a key")
    cols = [c for c in target.columns if c not in k]
    update_cols = [c for c in (update_cols if update_cols is not None else cols) if c in source.columns]
    keep_first = set(keep_first)
    src = source.select(*[C(c).alias(f"_src_{c}") for c in source.columns], F.lit(True).alias("_src_hit"))
    j = target.join(src, same_key(target, k, "_src_"), "left")
    out = []
    for c in cols:
        s = f"_src_{c}"
        if c in keep_first and s in j.columns:
            out.append(F.when(C("_src_hit"), F.coalesce(C(c), C(s))).otherwise(C(c)).alias(c))
        elif c in update_cols:
            out.append(F.when(C("_src_hit"), C(s)).otherwise(C(c)).alias(c))
        else:
            out.append(C(c))
    updated = j.select(*k, *out)
    inserted = absent(source, target, k)
    inserted = inserted.select(*[(C(c) if c in source.columns else F.lit(None)).cast(target.schema[c].dataType).alias(c)
                                 for c in target.columns])
    return updated.select(*target.columns).unionByName(inserted)


def insert_if_absent(target: DataFrame, candidates: DataFrame, key) -> DataFrame:
    """Rows of ``candidates`` whose key is not in ``target`` (ON CONFLICT DO NOTHING).

    Candidates are first made unique per key (the first insert wins in the
    reference; here the smallest row, deterministic).
    """
    return absent(one_per_key(candidates, key), target, key).select(*candidates.columns)


def insert_if_absent_state(target: DataFrame, candidates: DataFrame, key) -> DataFrame:
    """C2 as the new table state."""
    return target.unionByName(insert_if_absent(target, candidates, key), allowMissingColumns=True)


def update_from(target: DataFrame, source: DataFrame, key, set_cols: dict[str, str] | Sequence[str]) -> DataFrame:
    """UPDATE target SET c = s.c FROM source WHERE key matches AND c IS DISTINCT FROM s.c.

    Returns the new state plus a boolean ``changed`` column (sum it for the
    changed-row count the reference reports).  Several source rows for a key
    count as the smallest of them (``one_per_key``).
    """
    k = _keys(key)
    mapping = dict(set_cols) if isinstance(set_cols, dict) else {c: c for c in set_cols}
    src = source.select(*[C(c).alias(f"_key_{c}") for c in k],
                        *[C(s).alias(f"_new_{t}") for t, s in mapping.items()])
    src = one_per_key(src, [f"_key_{c}" for c in k]).withColumn("_hit", F.lit(True))
    j = target.join(src, same_key(target, k, "_key_"), "left")
    diff = F.lit(False)
    for t in mapping:
        diff = diff | (C("_hit") & ~C(t).eqNullSafe(C(f"_new_{t}")))
    cols = [F.when(C("_hit") & ~C(c).eqNullSafe(C(f"_new_{c}")), C(f"_new_{c}")).otherwise(C(c)).alias(c)
            if c in mapping else C(c) for c in target.columns]
    return j.select(*cols, F.coalesce(diff, F.lit(False)).alias("changed"))


def delete_where(df: DataFrame, cond: Column) -> DataFrame:
    """DELETE WHERE cond -- rows where the test is NULL stay."""
    return df.where(~cond | cond.isNull())


def replace_children(children: DataFrame, new_children: DataFrame, parent_key) -> DataFrame:
    """C11: drop every child of the parents present in ``new_children``, insert the new set.

    Keys compare null-safely: a new set without a parent replaces the children without one.
    """
    k = _keys(parent_key)
    parents = new_children.select(*[C(c).alias(f"_new_{c}") for c in k]).distinct()
    same = F.lit(True)
    for c in k:
        same = same & C(c).eqNullSafe(C(f"_new_{c}"))
    kept = children.join(parents, same, "left_anti")
    return kept.unionByName(new_children.select(*children.columns))


def align_schema(df: DataFrame, target_schema, renames: dict[str, str] | None = None) -> DataFrame:
    """Rename old columns, add missing ones as typed NULLs, order as the target."""
    renames = renames or {}
    for old, new in renames.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.select(*[(C(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in target_schema.fields])


def json_set(js: Column, key: str, value: Column) -> Column:
    """C9 ``jsonb_set`` on a top-level key of a JSON object text (value as JSON text)."""
    return json_merge(js, F.to_json(F.create_map(F.lit(key), value)))


def json_merge(js: Column, patch: Column) -> Column:
    """C9 ``jsonb || jsonb`` shallow merge of two JSON object texts; right side wins.

    Values are parsed as VARIANT, so nested objects, numbers, strings and
    nulls keep their JSON types; keys come out sorted.
    """
    m = "map<string,variant>"
    left = F.from_json(js, m)
    right = F.coalesce(F.from_json(patch, m), F.create_map().cast(m))
    kept = F.map_filter(left, lambda k, v: ~F.array_contains(F.map_keys(right), k))
    merged = F.map_concat(kept, right)
    by_key = F.array_sort(F.map_entries(merged),
                          lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.when(left.isNotNull(), F.to_json(F.map_from_entries(by_key)))


# ------------------------------------------------------------------ C4 editor
def apply_changes(table: DataFrame, changes: DataFrame, pk: Sequence[str], editable: Sequence[str]) -> dict:
    """C4: keyed patch/insert/delete batch with the editor's rules, applied in ``change_id`` order.

    ``changes``: change_id, op ('update'|'insert'|'delete'), the pk columns and
    ``values`` (map<string,string>).  Rules: the pk must be complete; pk,
    unknown, identity and generated columns are dropped from ``values``
    (``editable`` lists the rest); an update or insert needs at least one
    editable column; every value must be readable as its column's type;
    update/delete must hit exactly one row, insert none.

    Whether a row exists when a change comes follows from the last insert or
    delete before it (tried or done: after an insert there is a row, after a
    delete none), else from the table.  Accepted changes fold column by
    column, the latest value of each column since the row's last insert.

    Returns ``{"state", "audit"}``; audit has one row per change with
    status applied/rejected and the reason.
    """
    pk, editable = list(pk), list(editable)
    complete = F.lit(True)
    for c in pk:
        complete = complete & C(c).isNotNull()
    # Row counts only for the keys the batch touches.
    touched = changes.select(*pk).where(complete).distinct()
    hits = (table.select(*pk).join(touched, pk, "left_semi")
            .groupBy(*pk).agg(F.count(F.lit(1)).alias("_hits")))
    ch = changes.join(hits, pk, "left").withColumn("_hits", F.coalesce(C("_hits"), F.lit(0)))
    ch = ch.withColumn("_clean", F.coalesce(F.map_filter(C("values"), lambda k, v: k.isin(editable)),
                                            F.create_map().cast("map<string,string>")))
    unreadable = F.lit(None).cast("string")
    for c in reversed(editable):
        v = F.element_at(C("_clean"), c)
        unreadable = F.when(v.isNotNull() & v.try_cast(table.schema[c].dataType).isNull(), F.lit(c)).otherwise(unreadable)
    op = C("op")
    static = (F.when(~complete, "Complete primary key values are required.")
              .when(~F.coalesce(op.isin("update", "insert", "delete"), F.lit(False)), "Unsupported operation.")
              .when((op == "update") & (F.size("_clean") == 0), "No editable column changes were supplied.")
              .when((op == "insert") & (F.size("_clean") == 0), "No insert values were supplied.")
              .when((op != "delete") & unreadable.isNotNull(),
                    F.concat(F.lit("Invalid value for column '"), unreadable, F.lit("'."))))
    ch = ch.withColumn("_static", static)
    before = Window.partitionBy(*pk).orderBy("change_id").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.when(C("_static").isNull() & (C("_hits") <= 1) & (op != "update"), op)
    rows = F.coalesce(F.when(F.last(turn, ignorenulls=True).over(before) == "insert", F.lit(1).cast("long")),
                      F.when(F.last(turn, ignorenulls=True).over(before) == "delete", F.lit(0).cast("long")), C("_hits"))
    ch = ch.withColumn("_rows", rows)
    reason = (F.when(C("_static").isNotNull(), C("_static"))
              .when((op != "insert") & (C("_rows") != 1),
                    F.concat(F.lit("Expected one row; affected "), C("_rows").cast("string"), F.lit(".")))
              .when((op == "insert") & (C("_rows") != 0), "Row already exists."))
    ch = ch.withColumn("reason", reason)
    ok = ch.where(C("reason").isNull())
    # The row's last insert or delete, and the changes since: only these shape the result.
    last = ok.groupBy(*pk).agg(F.max(F.when(op != "update", F.struct("change_id", "op"))).alias("_turn"))
    since = ok.join(last, pk).where((op != "delete") & (C("_turn").isNull() | (C("change_id") >= C("_turn.change_id"))))
    cells = since.select(*pk, "change_id", F.explode("_clean").alias("_column", "_value"))
    cells = cells.groupBy(*pk, "_column").agg(F.max_by(F.struct("_value"), "change_id").alias("_v"))
    values = cells.groupBy(*pk).agg(F.map_from_entries(F.collect_list(F.struct("_column", "_v._value"))).alias("_new"))
    folded = last.join(values, pk, "left").select(*pk, C("_turn.op").alias("_op"), "_new")

    def cell(c):
        return F.element_at(C("_new"), c).try_cast(table.schema[c].dataType)

    kept = table.join(folded.where(C("_op").isNotNull()), pk, "left_anti") \
        .join(folded.where(C("_op").isNull()).select(*pk, "_new"), pk, "left")
    kept = kept.select(*[F.when(F.coalesce(F.map_contains_key(C("_new"), c), F.lit(False)), cell(c)).otherwise(C(c)).alias(c)
                         if c in editable else C(c) for c in table.columns])
    added = folded.where(C("_op") == "insert").select(
        *[C(c) if c in pk else (cell(c) if c in editable else F.lit(None).cast(table.schema[c].dataType)).alias(c)
          for c in table.columns])
    audit = ch.select("change_id", "op", *pk, F.when(C("reason").isNull(), "applied").otherwise("rejected").alias("status"),
                      "reason", F.array_join(F.array_sort(F.map_keys(C("_clean"))), ",").alias("columns"))
    return {"state": kept.unionByName(added), "audit": audit}


# ------------------------------------------------------------------ C6 review
# The reset-request statuses, the terminal ones, and the session
# status each decision maps to.
REVIEW_STATUSES = ["Requested", "Pending Admin Reconciliation", "Approved", "Completed", "Rejected"]
TERMINAL = ["Completed", "Rejected"]
SESSION_STATUS_FOR = {"Approved": "Reset Approved", "Completed": "Reset Complete", "Rejected": "Reset Rejected"}


def review_transitions(requests: DataFrame, decisions: DataFrame, reviewed_at: Column | None = None,
                       order: Sequence[str] = ()) -> dict:
    """Apply a batch of review decisions to reset requests.

    ``decisions``: request_id, status, admin_note, reviewed_by (and the columns in
    ``order``).  Decisions for one request apply one after the other, by ``order`` and then
    by their other columns; each sees the status the ones before it left.  A decision is
    rejected when the status is not allowed, the request is unknown, Completed is asked of
    a request that is not Approved, or the request is already terminal and the status
    differs.  Accepted decisions set status, completed_at (terminal statuses), note,
    reviewer and time; the mapped session status is in ``sessions`` (session_id, status),
    one row per accepted decision.  ``state`` has one row per request.

    An open status is always accepted while the request is open, so the status before a
    decision is the last open one asked for, until the first decision that ends the request.
    """
    now = reviewed_at if reviewed_at is not None else F.current_timestamp()
    cur = requests.select("request_id", C("status").alias("_cur"), C("session_id").alias("_session"))
    by = Window.partitionBy("request_id").orderBy(*order, "status", "admin_note", "reviewed_by")
    earlier, up_to = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0)
    status = C("status")
    d = decisions.join(cur, "request_id", "left").withColumn("_at", F.row_number().over(by))
    opens = F.when(status.isin(REVIEW_STATUSES) & ~status.isin(TERMINAL), status)
    d = d.withColumn("_before", F.coalesce(F.last(opens, ignorenulls=True).over(earlier), "_cur"))
    ends = F.when((status == "Rejected") | ((status == "Completed") & (C("_before") == "Approved")), status)
    d = d.withColumn("_end", ends).withColumn("_ended", F.first("_end", ignorenulls=True).over(earlier))
    d = d.withColumn("_now", F.when(C("_cur").isin(TERMINAL), C("_cur")).otherwise(F.coalesce("_ended", "_before")))
    reason = (F.when(~F.coalesce(status, F.lit("")).isin(REVIEW_STATUSES), "Unsupported reset-request status.")
              .when(C("_cur").isNull(), "Reset request not found.")
              .when((status == "Completed") & (C("_now") != "Approved"),
                    "A reset request must be Approved before it can be Completed.")
              .when(C("_now").isin(TERMINAL) & (status != C("_now")),
                    F.concat(F.lit("Reset request is already terminal ("), C("_now"), F.lit(")."))))
    d = d.withColumn("reason", reason)
    acc = d.where(C("reason").isNull()).groupBy("request_id").agg(
        F.max(F.struct("_at", "status", "admin_note", "reviewed_by")).alias("_last"),
        F.bool_or(status.isin(TERMINAL)).alias("_done"))
    j = requests.join(acc, "request_id", "left")
    hit = C("_last").isNotNull()
    stamp = lambda c: now.cast(requests.schema[c].dataType)
    new = {"status": (hit, lambda c: C("_last.status")), "admin_note": (hit, lambda c: C("_last.admin_note")),
           "reviewed_by": (hit, lambda c: C("_last.reviewed_by")), "reviewed_at": (hit, stamp),
           "completed_at": (F.coalesce("_done", F.lit(False)), stamp)}
    state = j.select(*[F.when(new[c][0], new[c][1](c)).otherwise(j[c]).alias(c) if c in new else j[c] for c in requests.columns])
    mapping = F.create_map(*[F.lit(x) for kv in SESSION_STATUS_FOR.items() for x in kv])
    sessions = (d.where(C("reason").isNull() & C("_session").isNotNull())
                .select(C("_session").alias("session_id"), F.element_at(mapping, status).alias("status"))
                .where(C("status").isNotNull()))
    rejected = d.where(C("reason").isNotNull()).select("request_id", "status", "reason")
    return {"state": state, "sessions": sessions, "rejected": rejected}


# ------------------------------------------------------------------ C7 checks
def check_constraints(df: DataFrame, key: str, *, not_null: Sequence[str] = (),
                      enums: dict[str, Sequence[str]] | None = None, non_negative: Sequence[str] = (),
                      unique: Sequence[Sequence[str]] = (), foreign: dict | None = None,
                      rules: dict[str, Column] | None = None) -> DataFrame:
    """Violations frame (constraint, key, detail) for one table.

    CHECK semantics: a NULL test passes, as do unique and foreign keys with a NULL part.
    ``foreign`` maps a column to ``(parent_df, parent_column)``.  ``rules`` are extra named
    CHECK expressions that must hold.

    The table is scanned once: each row yields the names of the row rules it breaks and its
    key values.  All unique and foreign keys are decided in one grouping of (constraint,
    value), to which parents add their values; only values found wrong go back to rows.
    """
    text = lambda c: c.cast("string")
    rules_ = [(f"{c}_not_null", C(c).isNull(), F.lit(None)) for c in not_null]
    rules_ += [(f"{c}_check", ~C(c).isin(list(allowed)), C(c)) for c, allowed in (enums or {}).items()]
    rules_ += [(f"{c}_non_negative", C(c) < 0, C(c)) for c in non_negative]
    rules_ += [(name, ~cond, F.lit(None)) for name, cond in (rules or {}).items()]
    keys = [("_".join(cols) + "_unique", list(cols), 2) for cols in unique]
    keys += [(f"{c}_fkey", [c], 1) for c in (foreign or {})]
    entry = "array<struct<name:string,value:string,detail:string,kind:int>>"
    broken = [F.when(bad, F.struct(F.lit(name).alias("name"), F.lit(None).cast("string").alias("value"), text(detail).alias("detail"),
                                   F.lit(0).alias("kind"))) for name, bad, detail in rules_]
    probes = []
    for name, cols, kind in keys:
        whole = F.lit(True)
        for c in cols:
            whole = whole & C(c).isNotNull()
        probes.append(F.when(whole, F.struct(
            F.lit(name).alias("name"), F.to_json(F.array(*[text(C(c)) for c in cols])).alias("value"),
            F.concat_ws("|", *[text(C(c)) for c in cols]).alias("detail"), F.lit(kind).alias("kind"))))
    found = F.array_compact(F.array(*broken, *probes)).cast(entry)
    rows = df.select(text(C(key)).alias("row_key"), F.explode(found).alias("x")).select("row_key", "x.*")
    out = lambda x: x.select(C("name").alias("constraint_name"), "row_key", "detail")
    if not keys:
        return out(rows)
    rows = cut_lineage(rows)
    asked = rows.where("kind > 0").select("name", "value", "kind", F.lit(1).alias("rows"))
    for c, (parent, pcol) in (foreign or {}).items():
        known = F.to_json(F.array(text(C(pcol).cast(df.schema[c].dataType))))
        asked = asked.unionByName(parent.where(C(pcol).isNotNull()).select(
            F.lit(f"{c}_fkey").alias("name"), known.alias("value"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("rows")))
    # a unique value is wrong when it has several rows, a foreign one when no parent has it
    wrong = asked.groupBy("name", "value", "kind").agg(F.count("rows").alias("n"), F.count(F.lit(1)).alias("m")) \
        .where("(kind = 2 and n > 1) or (kind = 1 and m = n)").select("name", "value")
    return out(rows.where("kind = 0")).unionByName(out(rows.where("kind > 0").join(wrong, ["name", "value"], "left_semi")))


# ------------------------------------------------------------------ C5 documents
def patch_key_error(patch: Column) -> Column:
    """Reason a ``$set`` patch is refused: ``_id`` forbidden, keys may not start with '$' or contain '.'."""
    keys = F.json_object_keys(patch)
    bad = F.filter(keys, lambda k: (k == "_id") | k.startswith("$") | k.contains("."))
    return (F.when(patch.isNull() | keys.isNull(), F.lit("Patch must be a JSON object."))
            .when(F.size(bad) > 0, F.concat(F.lit("Invalid field name '"), F.element_at(bad, 1), F.lit("'."))))


def patch_documents(docs: DataFrame, patches: DataFrame, id_col: str = "_id", doc_col: str = "doc",
                    patch_col: str = "patch") -> DataFrame:
    """Top-level ``$set`` merge of a patch into each matching document.

    Returns every document with ``doc`` patched where a valid patch exists,
    plus ``patch_error`` for refused patches (the document is left as is).
    Several patches for a document count as the smallest of them as text.
    """
    p = one_per_key(patches.select(id_col, C(patch_col).alias("_patch")), id_col)
    p = p.withColumn("patch_error", patch_key_error(C("_patch")))
    j = docs.join(p, id_col, "left")
    ok = C("_patch").isNotNull() & C("patch_error").isNull()
    return j.withColumn(doc_col, F.when(ok, json_merge(C(doc_col), C("_patch"))).otherwise(C(doc_col))).drop("_patch")
