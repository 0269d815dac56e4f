"""Restore of all tables from one saved snapshot.

Every new state is derived from the baseline rows of one ``snapshot_id``: lots and their
mirror, the staged positions, and the tanks.  A baseline key that occurs more than once
counts once (its smallest row), so it cannot double a live row.  The comparison after the
restore applies the same rules to the baseline before it compares, and ``publish`` puts
all tables in place together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.operators.changes import delete_where, one_per_key
from keelson.session import scratch_path
from keelson.sources.publish import publish

C = F.col

# The staging locations that a restore rebuilds.
STAGING = ("CW-STAGE-01", "CW-HAZ-01")
TANK_COLUMNS = ("quantity_kg", "qa_status", "lot_number", "temperature_c", "status")
STAGED_COLUMNS = ("container_id", "material_code", "lot_number", "quantity", "location_code", "hazard_class")


def lot_status(status: str = "status") -> Column:
    """Released, in any case, becomes available; every other status stays as it is written."""
    return F.when(F.lower(status) == "released", F.lit("available")).otherwise(C(status))


def mirror_status(status: str = "status") -> Column:
    """Available and released, in any case, read Released; others get initial capitals."""
    return F.when(F.lower(status).isin("available", "released"), F.lit("Released")).otherwise(F.initcap(status))


def of_snapshot(baseline: DataFrame, snapshot_id: str, key: str) -> DataFrame:
    """One row per key of the named snapshot, without its id; rows without a key are left out."""
    rows = baseline.where((C("snapshot_id") == snapshot_id) & C(key).isNotNull()).drop("snapshot_id")
    return one_per_key(rows, key)


def snapshot_rows(saved: dict[str, DataFrame], snapshot_id: str) -> dict[str, DataFrame]:
    """The named snapshot's ``lots`` and ``tanks``, one row per key, and its ``staged`` rows."""
    return {"lots": of_snapshot(saved["lots"], snapshot_id, "internal_lot_number"),
            "tanks": of_snapshot(saved["tanks"], snapshot_id, "tank_code"),
            "staged": saved["staged"].where(C("snapshot_id") == snapshot_id)}


def stored_snapshot(saved: dict[str, DataFrame], snapshot_id: str) -> dict[str, DataFrame]:
    """``snapshot_rows`` with lots and tanks written to the shared folder: reduced once, whoever reads them."""
    rows = snapshot_rows(saved, snapshot_id)
    for name in ("lots", "tanks"):
        path = scratch_path(rows[name].sparkSession, f"snapshot-{name}-{uuid.uuid4().hex}")
        rows[name].write.parquet(path)
        rows[name] = rows[name].sparkSession.read.schema(rows[name].schema).parquet(path)
    return rows


def overwrite(live: DataFrame, saved: DataFrame, key: str, values: dict[str, Column], saved_key: str | None = None) -> DataFrame:
    """``live`` with the named columns set from ``saved`` (one row per key) where the key is saved; other rows stay."""
    new = saved.select(C(saved_key or key).alias("_key"), F.lit(True).alias("_saved"),
                       *[v.alias(f"_new_{c}") for c, v in values.items()])
    j = live.join(new, C(key) == C("_key"), "left")
    return j.select(*[F.when(C("_saved"), C(f"_new_{c}")).otherwise(C(c)).alias(c) if c in values else C(c) for c in live.columns])


def restored_states(live: dict[str, DataFrame], saved: dict[str, DataFrame], snapshot_id: str,
                    staging: tuple[str, ...] = STAGING, rows: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """New states of ``lots``, ``mirror``, ``staged`` and ``tanks`` from the snapshot's ``lots``, ``staged`` and ``tanks``.

    ``lots`` take available and reserved quantity and the status (released reads available);
    ``mirror`` follows the lots' baseline in its own words; positions at the staging
    locations are dropped and the saved ones inserted as Staged without campaign, order and
    request; ``tanks`` take all saved columns.  ``rows``: the snapshot's rows, where they are at hand.
    """
    rows = rows or snapshot_rows(saved, snapshot_id)
    lots, tanks, back = rows["lots"], rows["tanks"], rows["staged"]
    kept = delete_where(live["staged"], C("location_code").isin(list(staging)))
    types = {f.name: f.dataType for f in live["staged"].schema.fields}
    fresh = {c: C(c) for c in STAGED_COLUMNS} | {"status": F.lit("Staged")}
    back = back.select(*[fresh.get(c, F.lit(None)).cast(types[c]).alias(c) for c in live["staged"].columns])
    return {
        "lots": overwrite(live["lots"], lots, "internal_lot_number", {
            "available_quantity": C("available_quantity"), "reserved_quantity": C("reserved_quantity"), "status": lot_status()}),
        "mirror": overwrite(live["mirror"], lots, "lot_number", {
            "quantity": C("available_quantity"), "reserved_quantity": C("reserved_quantity"), "qa_status": mirror_status()},
            saved_key="internal_lot_number"),
        "staged": kept.unionByName(back),
        "tanks": overwrite(live["tanks"], tanks, "tank_code", {c: C(c) for c in TANK_COLUMNS})}


def _differing(state: DataFrame, saved: DataFrame, key: str, saved_key: str, pairs: dict[str, Column]) -> DataFrame:
    """Rows of ``state`` with a saved key whose columns are not the (remapped) saved ones."""
    want = saved.select(C(saved_key).alias("_key"), *[v.alias(f"_want_{c}") for c, v in pairs.items()])
    same = F.lit(True)
    for c in pairs:
        same = same & C(c).eqNullSafe(C(f"_want_{c}"))
    return state.join(want, C(key) == C("_key")).withColumn("_same", same)


def compared(states: dict[str, DataFrame], saved: dict[str, DataFrame], snapshot_id: str,
             staging: tuple[str, ...] = STAGING, rows: dict[str, DataFrame] | None = None) -> DataFrame:
    """R4 (table_name, compared, mismatches) of states against the snapshot, remapped as the restore remaps it.

    Staged positions are compared as sets of rows with their counts, in both directions.
    ``rows``: the snapshot's rows, where they are at hand.
    """
    rows = rows or snapshot_rows(saved, snapshot_id)
    lots, tanks = rows["lots"], rows["tanks"]
    checks = {
        "lots": _differing(states["lots"], lots, "internal_lot_number", "internal_lot_number", {
            "available_quantity": C("available_quantity"), "reserved_quantity": C("reserved_quantity"), "status": lot_status()}),
        "mirror": _differing(states["mirror"], lots, "lot_number", "internal_lot_number", {
            "quantity": C("available_quantity"), "reserved_quantity": C("reserved_quantity"), "qa_status": mirror_status()}),
        "tanks": _differing(states["tanks"], tanks, "tank_code", "tank_code", {c: C(c) for c in TANK_COLUMNS})}
    here = states["staged"].where(C("location_code").isin(list(staging))).select(*STAGED_COLUMNS, F.lit(1).alias("_n"))
    there = rows["staged"].select(*STAGED_COLUMNS, F.lit(-1).alias("_n"))
    both = here.unionByName(there).groupBy(*STAGED_COLUMNS).agg(F.sum("_n").alias("_n"), F.sum(F.abs("_n")).alias("_m"))
    out = both.agg(F.lit("staged").alias("table_name"), F.coalesce(F.sum("_m"), F.lit(0)).alias("compared"),
                   F.coalesce(F.sum(F.abs("_n")), F.lit(0)).alias("mismatches"))
    for name, found in checks.items():
        out = out.unionByName(found.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("compared"),
                                       F.count_if(~C("_same")).alias("mismatches")))
    return out


def restore_and_publish(live: dict[str, DataFrame], saved: dict[str, DataFrame], snapshot_id: str, root: str,
                        rows: dict[str, DataFrame] | None = None) -> int:
    """Restore all tables and publish them at ``root`` as one version, refused if any row differs from the snapshot.

    Both the new states and the audit read ``rows`` (``stored_snapshot``, unless given).
    """
    rows = rows or stored_snapshot(saved, snapshot_id)
    states = restored_states(live, saved, snapshot_id, rows=rows)
    return publish(states, root, {
        "restored": lambda written: compared(written, saved, snapshot_id, rows=rows).where("mismatches > 0")})
