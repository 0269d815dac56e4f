"""Catalog, registry and lineage upkeep (K3-K9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators.changes import insert_if_absent, one_per_key

C = F.col


def profile_table(df: DataFrame, table_name: str, exact_distinct: bool = False) -> DataFrame:
    """K3: per column type, non-null count and distinct count (HyperLogLog estimate unless exact); row count.

    One aggregate over all columns, then unpivoted: one pass over the data.
    """
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(df.schema.fields):
        c = C(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"_nn{i}"))
        aggs.append((F.count_distinct(c) if exact_distinct else F.approx_count_distinct(c)).alias(f"_d{i}"))
    a = df.agg(*aggs)
    rows = [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
                     F.lit(i).alias("ordinal"), C(f"_nn{i}").alias("non_null"), C(f"_d{i}").alias("distinct_values"))
            for i, f in enumerate(df.schema.fields)]
    out = a.select(C("_rows").alias("row_count"), F.explode(F.array(*rows)).alias("c"))
    return out.select(F.lit(table_name).alias("table_name"), "c.column_name", "c.data_type",
                      C("c.ordinal").cast("int").alias("ordinal"), "c.non_null", "c.distinct_values", "row_count")


def profile_sample(df: DataFrame, order: list, n: int = 25) -> DataFrame:
    """K3 sample rows (a top-n by the given order)."""
    return df.orderBy(*order).limit(n)


def discover(spark, paths: dict[str, str], include=None, exclude=()) -> DataFrame:
    """K4: one row per parquet object: key, name, column count, estimated rows.

    The row count comes from a count over the object (parquet answers it
    from footers); include/exclude filter the object names.
    """
    rows = []
    for name, path in sorted(paths.items()):
        if (include is not None and name not in include) or name in exclude:
            continue
        df = spark.read.parquet(path)
        rows.append(df.agg(F.count(F.lit(1)).alias("estimated_rows")).select(
            F.lit(f"parquet.default.{name}").alias("dataset_key"), F.lit(name).alias("object_name"),
            F.lit(len(df.schema)).alias("column_count"), "estimated_rows"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def register_datasets(discovered: DataFrame, registered: DataFrame, keys=("system_id", "dataset_key"),
                      update_existing: bool = True) -> DataFrame:
    """K5: action per discovered dataset -- created (new key), updated, or skipped (exists, no update)."""
    k = list(keys)
    hit = registered.select(*k).distinct().withColumn("_exists", F.lit(True))
    j = discovered.join(hit, k, "left")
    action = F.when(C("_exists").isNull(), "created")
    action = action.when(F.lit(update_existing), "updated").otherwise("skipped")
    return j.withColumn("action", action).drop("_exists")


def next_registry(discovered: DataFrame, registered: DataFrame, keys=("system_id", "dataset_key"),
                  update_existing: bool = True, active: str = "is_active") -> DataFrame:
    """K5: the registry after a discovery, with the ``action`` of each row.

    One full outer join on the null-safe keys: ``created`` (only discovered), ``updated``
    (both, and some column differs or the entry was inactive), ``skipped`` (both, without
    ``update_existing``), ``unchanged`` (equal, or not discovered).  Columns that were not
    discovered keep their registered values; created entries are active.  Applying the same
    discovery again leaves every row unchanged (or skipped).
    """
    k = list(keys)
    new = one_per_key(discovered, k)
    given = [c for c in new.columns if c not in k and c in registered.columns]
    new = new.select(*[C(c).alias(f"_new_{c}") for c in [*k, *given]], F.lit(True).alias("_found"))
    old = one_per_key(registered, k).withColumn("_known", F.lit(True))
    same_key = F.lit(True)
    for c in k:
        same_key = same_key & C(c).eqNullSafe(C(f"_new_{c}"))
    j = old.join(new, same_key, "full")
    differs = ~F.coalesce(C(active), F.lit(False)) if active in registered.columns else F.lit(False)
    for c in given:
        differs = differs | ~C(c).eqNullSafe(C(f"_new_{c}"))
    action = (F.when(C("_known").isNull(), "created").when(C("_found").isNull(), "unchanged")
              .when(F.lit(not update_existing), "skipped").when(differs, "updated").otherwise("unchanged"))
    j = j.withColumn("action", action)
    written = C("action").isin("created", "updated")
    cols = []
    for c in registered.columns:
        if c in k:
            cols.append(F.when(C("action") == "created", C(f"_new_{c}")).otherwise(C(c)).alias(c))
        elif c == active:
            cols.append(F.when(written, F.lit(True)).otherwise(C(c)).alias(c))
        elif c in given:
            cols.append(F.when(written, C(f"_new_{c}")).otherwise(C(c)).alias(c))
        else:
            cols.append(C(c))
    return j.select(*cols, "action")


def registry_list(systems: DataFrame, datasets: DataFrame, system_id=None) -> tuple[DataFrame, DataFrame]:
    """K6: systems by name; datasets by (system, schema, object, name), optional system filter."""
    d = datasets if system_id is None else datasets.where(C("system_id") == system_id)
    return (systems.orderBy("system_name"),
            d.orderBy("system_id", "schema_name", "object_name", "dataset_name"))


LINEAGE_KEY = ["source_system", "source_dataset", "target_system", "target_dataset"]


def add_lineage(existing: DataFrame, edges: DataFrame) -> DataFrame:
    """K7: edges to insert -- unless the same (source system, dataset, target system, dataset) exists."""
    return insert_if_absent(existing, edges, LINEAGE_KEY)


def add_relationship(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """K8: new dataset relationships; unique triple, no self link."""
    c = candidates.where(C("source_dataset_id") != C("target_dataset_id"))
    return insert_if_absent(existing, c, ["source_dataset_id", "target_dataset_id", "relationship_type"])


def system_lens(lens: DataFrame, systems: DataFrame, datasets: DataFrame) -> DataFrame:
    """K9: a lens value (system id or key) resolved to its system, with its dataset count.

    The registry becomes one lookup with one row per value (a match by id
    ranks before a match by key), so each lens value takes a single
    equi-join that cannot fan out -- not an OR join.
    """
    sysrow = F.struct("system_id", "system_key", "system_name")
    rows = (systems.select(C("system_id").cast("string").alias("_v"), F.lit(1).alias("_rank"), sysrow.alias("_s"))
            .unionByName(systems.select(C("system_key").cast("string").alias("_v"), F.lit(2).alias("_rank"),
                                        sysrow.alias("_s")))
            .where(C("_v").isNotNull()))
    lookup = rows.groupBy("_v").agg(F.min(F.struct("_rank", "_s")).alias("_b")).select("_v", C("_b._s").alias("_s"))
    res = lens.join(lookup, C("lens_value") == C("_v"), "left")
    counts = datasets.groupBy("system_id").agg(F.count(F.lit(1)).alias("datasets"))
    out = res.select("lens_value", C("_s.system_id").alias("system_id"), C("_s.system_key").alias("system_key"),
                     F.coalesce(C("_s.system_name"), C("lens_value")).alias("system_name"))
    return out.join(counts, "system_id", "left").select(
        "lens_value", "system_id", "system_key", "system_name",
        F.coalesce(C("datasets"), F.lit(0)).cast("long").alias("datasets"))
