"""Document find and aggregation stages (F2, F3, F5, D1-D12) as DataFrame transforms.

Each aggregation stage is a plain function taking Columns, composed in
Python -- there is no pipeline-language interpreter.  Missing fields read as
NULL.  Sorts follow the document store: NULL first ascending, last
descending, with the id as the final tiebreak so limits are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, MapType, StructType, ArrayType, TimestampNTZType, TimestampType

C = F.col


def _at_least(name: str, value: int, least: int) -> int:
    if int(value) < least:
        raise ValueError(f"{name} must be at least {least}, not {value}.")
    return int(value)


def doc_sort_cols(spec: Sequence[tuple[str, int]], id_col: str | None = None) -> list[Column]:
    """``{field: 1|-1}`` -> orderBy columns (asc: NULLs first, desc: NULLs last)."""
    cols = [C(f).asc_nulls_first() if d >= 0 else C(f).desc_nulls_last() for f, d in spec]
    if id_col and id_col not in [f for f, _ in spec]:
        cols.append(C(id_col).asc())
    return cols


def doc_find(df: DataFrame, cond: Column | None = None, sort: tuple[str, int] | None = None,
             limit: int | None = None, id_col: str = "_id", fields: Sequence[str] | None = None) -> DataFrame:
    """filter, optional one-field sort, and the caller's limit (a top-k); no limit returns all, in order."""
    out = df.where(cond) if cond is not None else df
    if fields:
        out = out.select(*fields)
    out = out.orderBy(*doc_sort_cols([sort] if sort else [], id_col))
    return out if limit is None else out.limit(_at_least("limit", limit, 1))


def doc_by_id(df: DataFrame, id_value, id_col: str = "_id") -> DataFrame:
    """F2 id lookup."""
    return df.where(C(id_col) == F.lit(id_value))


def paginate(df: DataFrame, pk: Sequence[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """page ordered by the full primary key; ``total_rows`` on every row."""
    limit, offset = _at_least("limit", limit, 1), _at_least("offset", offset, 0)
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    page = df.orderBy(*[C(k).asc_nulls_last() for k in pk]).offset(offset).limit(limit)
    return page.crossJoin(total)  # page x one row


def json_safe(df: DataFrame) -> DataFrame:
    """dates/timestamps -> ISO text, decimals -> double, nested values -> JSON text."""
    cols = []
    for f in df.schema.fields:
        c = C(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (TimestampType, TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        elif isinstance(t, DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, DecimalType):
            c = c.cast("double")
        elif isinstance(t, (StructType, MapType, ArrayType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


# ------------------------------------------------------------------ stages
def doc_match(df: DataFrame, cond: Column) -> DataFrame:
    """D1 $match."""
    return df.where(cond)


def doc_project(df: DataFrame, fields: dict[str, Column | str]) -> DataFrame:
    """D2 $project: keep/compute exactly the named fields."""
    return df.select(*[(C(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])


def doc_add_fields(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """D2 $addFields."""
    for k, v in fields.items():
        df = df.withColumn(k, v)
    return df


def doc_group(df: DataFrame, key: str | Column | None, accumulators: dict[str, Column]) -> DataFrame:
    """D3 $group: ``_id`` plus accumulators (sum/avg/min/max/first via min_by/addToSet)."""
    k = (C(key) if isinstance(key, str) else key) if key is not None else F.lit(None)
    return df.groupBy(k.alias("_id")).agg(*[v.alias(n) for n, v in accumulators.items()])


def exact_avg(c: str) -> Column:
    """$avg over integers, order independent: exact SUM / COUNT as DOUBLE."""
    return F.sum(C(c)).cast("double") / F.count(C(c))


def doc_sort(df: DataFrame, spec: Sequence[tuple[str, int]], id_col: str | None = None) -> DataFrame:
    """D4 $sort."""
    return df.orderBy(*doc_sort_cols(spec, id_col))


def doc_limit(df: DataFrame, n: int, skip: int = 0) -> DataFrame:
    """D5 $skip + $limit (after a $sort)."""
    return (df.offset(skip) if skip else df).limit(n)


def doc_count(df: DataFrame, name: str = "count") -> DataFrame:
    """D6 $count."""
    return df.agg(F.count(F.lit(1)).alias(name))


def doc_unwind(df: DataFrame, array_col: Column, as_name: str, index_name: str | None = None,
               preserve_empty: bool = False) -> DataFrame:
    """D7 $unwind (with includeArrayIndex / preserveNullAndEmptyArrays)."""
    if index_name:
        gen = F.posexplode_outer(array_col) if preserve_empty else F.posexplode(array_col)
        return df.select("*", gen.alias(index_name, as_name))
    gen = F.explode_outer(array_col) if preserve_empty else F.explode(array_col)
    return df.select("*", gen.alias(as_name))


def doc_lookup(df: DataFrame, other: DataFrame, local: str, foreign: str, as_name: str,
               fields: Sequence[str]) -> DataFrame:
    """D8 $lookup: matches gathered per local key into a sorted array (no match -> []).

    The foreign side is grouped per key first (partial aggregation), then
    left-joined, so each outer row is joined to at most one grouped row.
    """
    grouped = (other.groupBy(C(foreign).alias("_fk"))
               .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_arr")))
    j = df.join(grouped, C(local) == C("_fk"), "left")
    empty = F.array().cast(grouped.schema["_arr"].dataType)
    return j.withColumn(as_name, F.coalesce(C("_arr"), empty)).drop("_fk", "_arr")


def doc_sort_by_count(df: DataFrame, expr: str | Column) -> DataFrame:
    """D9 $sortByCount."""
    k = C(expr) if isinstance(expr, str) else expr
    return df.groupBy(k.alias("_id")).agg(F.count(F.lit(1)).alias("count")) \
        .orderBy(C("count").desc(), C("_id").asc_nulls_first())


def doc_bucket(df: DataFrame, group_by: str | Column, boundaries: Sequence, default: str = "Other",
               output: dict[str, Column] | None = None) -> DataFrame:
    """D10 $bucket: [b_i, b_i+1) buckets labelled by their lower bound, others -> ``default``."""
    v = C(group_by) if isinstance(group_by, str) else group_by
    label = F.lit(default)
    for lo, hi in reversed(list(zip(boundaries[:-1], boundaries[1:]))):
        label = F.when((v >= lo) & (v < hi), F.lit(str(lo))).otherwise(label)
    out = output or {"count": F.count(F.lit(1))}
    return df.groupBy(label.alias("_id")).agg(*[c.alias(n) for n, c in out.items()])


def doc_sample(df: DataFrame, n: int, id_col: str, seed: int = 0) -> DataFrame:
    """D11 $sample: the n rows with the smallest seeded hash of the id (deterministic, a top-k)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), C(id_col).cast("string")))
    return df.withColumn("_h", h).orderBy("_h").limit(n).drop("_h")


def doc_union(df: DataFrame, other: DataFrame) -> DataFrame:
    """D12 $unionWith: missing fields become NULL."""
    return df.unionByName(other, allowMissingColumns=True)


def capped_query(df: DataFrame, n: int, order: list) -> DataFrame:
    """cap a query result at ``n`` rows with a stated order (plan-level limit, a top-k)."""
    return df.orderBy(*order).limit(int(n))


def doc_lookup_unwind(df: DataFrame, other: DataFrame, local: str, foreign: str, fields: Sequence[str],
                      preserve_empty: bool = True) -> DataFrame:
    """D8 + D7: ``$lookup`` followed by ``$unwind`` as one flat join (no per-key arrays).

    With ``preserveNullAndEmptyArrays`` an outer row without matches is kept
    once with NULL fields (left join), otherwise dropped (inner join).  A key
    with a huge number of matches stays spread over rows and partitions.
    """
    right = other.select(C(foreign).alias("_fk"), *fields)
    j = df.join(right, C(local) == C("_fk"), "left" if preserve_empty else "inner")
    return j.drop("_fk")
