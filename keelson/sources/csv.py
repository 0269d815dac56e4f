"""Delimited-file loading (L1, L2, L5): read as text, infer types, typed load with rejects.

Type inference is one aggregate over all columns (``bool_and`` per column and
candidate type), not one job per column; the typed load is one projection
with ``try_cast`` per column and a filter each way, so ``read = accepted +
rejected`` by construction.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.time import iso_timestamp

C = F.col

# The inference word lists and the delimiter candidates.
BOOLEAN_WORDS = ["true", "false", "yes", "no", "1", "0"]
TRUE_WORDS = ["true", "yes", "1"]
FALSE_WORDS = ["false", "no", "0"]
DELIMITERS = [",", ";", "\t", "|"]
INT_RE = r"^[+-]?[0-9]+$"
FLOAT_RE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
FLOAT_WORDS = ["nan", "+nan", "-nan", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]
TARGET_TYPES = ["TEXT", "BIGINT", "INTEGER", "DOUBLE PRECISION", "NUMERIC", "BOOLEAN", "TIMESTAMPTZ", "DATE"]


# ------------------------------------------------------------------ names
def normalize_identifier(value: str) -> str:
    """A name made of the runs of letters and digits, lower-cased and joined by '_'.

    Without any it is 'column'; one that starts with a digit gets 'col_' in front.
    """
    name = "_".join(re.findall(r"[^\W_]+", value.lower())) or "column"
    return "col_" + name if name[0].isdigit() else name


def unique_identifiers(names: Sequence[str]) -> list[str]:
    """Normalise and de-duplicate with _2, _3, ... suffixes."""
    used: set[str] = set()
    out = []
    for n in names:
        base = normalize_identifier(n)
        cand, k = base, 2
        while cand in used:
            cand, k = f"{base}_{k}", k + 1
        used.add(cand)
        out.append(cand)
    return out


# ------------------------------------------------------------------ L1
def sniff_delimiter(head: str) -> str:
    """Most frequent of , ; TAB | in the first line of the head; ',' when none appears."""
    first = head.lstrip("﻿").splitlines()[0] if head else ""
    counts = {d: first.count(d) for d in DELIMITERS}
    best = max(counts, key=lambda d: (counts[d], -DELIMITERS.index(d)))
    return best if counts[best] > 0 else ","


def csv_source(spark: SparkSession, path: str, delimiter: str | None = None, multi_line: bool = True,
               bad_rows: str | None = None) -> DataFrame:
    """L1: every column as STRING, header names normalised, BOM dropped, quoted newlines kept.

    Without ``delimiter`` it is sniffed from the header line of one file: a
    ``limit(1)`` over the text source reads only that line, on any Hadoop file
    system.  Files whose quoted fields hold no line ends can be read with
    ``multi_line=False``, which splits large files over tasks.  ``bad_rows``
    names a column that holds the whole line of a row with more or fewer
    fields than the header (NULL for good rows), see ``split_bad_rows``.
    """
    if delimiter is None:
        head_row = spark.read.text(path).limit(1).collect()
        delimiter = sniff_delimiter(head_row[0][0] if head_row else "")
    reader = (spark.read.option("header", True).option("sep", delimiter).option("multiLine", multi_line)
              .option("quote", '"').option("escape", '"').option("encoding", "UTF-8").option("inferSchema", False))
    found = reader.csv(path).columns
    names = unique_identifiers([c.lstrip("﻿") for c in found])
    if bad_rows is None:
        return reader.csv(path).toDF(*names)
    schema = ", ".join(f"`{n}` string" for n in [*names, bad_rows])
    return reader.schema(schema).option("enforceSchema", True).option("columnNameOfCorruptRecord", bad_rows).csv(path)


def split_bad_rows(df: DataFrame, bad_rows: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines as (reason, original_row)) of a ``csv_source`` with a ``bad_rows`` column."""
    wrong = C(f"`{bad_rows}`")
    rejected = df.where(wrong.isNotNull()).select(F.lit("Row has more or fewer fields than the header.").alias("reason"),
                                                  wrong.alias("original_row"))
    return df.where(wrong.isNull()).drop(bad_rows), rejected


# ------------------------------------------------------------------ L2
def _clean(c: Column) -> Column:
    v = F.trim(c)
    return F.when(F.length(v) > 0, v)


def is_boolean(v: Column) -> Column:
    return F.lower(v).isin(BOOLEAN_WORDS)


def is_integer(v: Column) -> Column:
    return v.rlike(INT_RE)


def is_float(v: Column) -> Column:
    return v.rlike(FLOAT_RE) | F.lower(v).isin(FLOAT_WORDS)


def is_timestamp(v: Column) -> Column:
    return iso_timestamp(v).isNotNull()


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """L2: (column, type, nullable, ordinal) from all rows of ``df`` (sample first if wanted).

    Precedence BOOLEAN -> BIGINT -> DOUBLE PRECISION -> TIMESTAMPTZ -> TEXT;
    a column with no non-blank value is (TEXT, nullable).
    """
    columns = list(columns or df.columns)
    aggs = []
    for i, c in enumerate(columns):
        v = _clean(C(f"`{c}`").cast("string"))
        aggs += [F.count(v).alias(f"n{i}"), F.count(F.lit(1)).alias(f"r{i}"),
                 F.bool_and(F.coalesce(is_boolean(v), F.lit(True))).alias(f"b{i}"),
                 F.bool_and(F.coalesce(is_integer(v), F.lit(True))).alias(f"i{i}"),
                 F.bool_and(F.coalesce(is_float(v), F.lit(True))).alias(f"f{i}"),
                 F.bool_and(F.coalesce(v.isNull() | is_timestamp(v), F.lit(True))).alias(f"t{i}")]
    a = df.agg(*aggs)
    rows = []
    for i, c in enumerate(columns):
        typ = (F.when(C(f"n{i}") == 0, "TEXT").when(C(f"b{i}"), "BOOLEAN").when(C(f"i{i}"), "BIGINT")
               .when(C(f"f{i}"), "DOUBLE PRECISION").when(C(f"t{i}"), "TIMESTAMPTZ").otherwise("TEXT"))
        nullable = (C(f"n{i}") != C(f"r{i}")) | (C(f"n{i}") == 0)
        rows.append(F.struct(F.lit(c).alias("column_name"), typ.alias("data_type"), nullable.alias("nullable"),
                             F.lit(i).alias("ordinal")))
    return a.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


# ------------------------------------------------------------------ L5
def convert(v: Column, target: str) -> Column:
    """Typed value of cleaned text ``v`` (NULL when it does not convert)."""
    t = target.upper()
    if t in ("BIGINT", "INTEGER"):
        typ = "long" if t == "BIGINT" else "int"
        return F.when(is_integer(v), v.try_cast(typ))
    if t in ("DOUBLE PRECISION", "NUMERIC", "DOUBLE"):
        return F.when(is_float(v), v.try_cast("double"))
    if t == "BOOLEAN":
        lw = F.lower(v)
        return F.when(lw.isin(TRUE_WORDS), F.lit(True)).when(lw.isin(FALSE_WORDS), F.lit(False))
    if t == "TIMESTAMPTZ":
        return iso_timestamp(v)
    if t == "DATE":
        return v.try_cast("date")
    return v


def validate_mapping(mapping: dict[str, str], source_columns: Sequence[str]) -> None:
    """Mapping rules: at least one column, non-blank unique targets, known sources and types."""
    if not mapping:
        raise ValueError("At least one column must be mapped.")
    targets = [t for t, _ in mapping.values()] if all(isinstance(v, tuple) for v in mapping.values()) else None
    if targets is not None:
        if any(not t.strip() for t in targets) or len(set(targets)) != len(targets):
            raise ValueError("Target column names must be non-blank and unique.")
    for src, spec in mapping.items():
        if src not in source_columns:
            raise ValueError(f"Unknown source column {src}.")
        typ = spec[1] if isinstance(spec, tuple) else spec
        if typ.upper() not in TARGET_TYPES:
            raise ValueError(f"Unsupported target type {typ}.")


def typed_load(df: DataFrame, mapping: dict, row_number: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected).

    ``mapping``: source column -> type, or -> (target name, type).
    ``row_number`` names the file line column (first data row = 2).  A value
    is rejected when it is non-blank but does not convert; blank -> NULL.
    Rejected rows keep the row number, the reason(s) and the original values.
    """
    validate_mapping(mapping, df.columns)
    typed, bad = [], []
    for src, spec in mapping.items():
        target, typ = spec if isinstance(spec, tuple) else (normalize_identifier(src), spec)
        v = _clean(C(f"`{src}`").cast("string"))
        t = convert(v, typ)
        typed.append(t.alias(target))
        bad.append(F.when(v.isNotNull() & t.isNull(),
                          F.concat(F.lit(f"{target}: invalid {typ.upper()} value \""), v, F.lit('"'))))
    reasons = F.array_compact(F.array(*bad))
    x = df.select(C(row_number).alias("row_number"), *typed, reasons.alias("_reasons"),
                  F.to_json(F.struct(*[C(f"`{c}`") for c in df.columns if c != row_number])).alias("original_row"))
    accepted = x.where(F.size("_reasons") == 0).drop("_reasons", "original_row", "row_number")
    rejected = x.where(F.size("_reasons") > 0).select("row_number", F.array_join("_reasons", "; ").alias("reason"),
                                                      "original_row")
    return accepted, rejected


def with_line_numbers(df: DataFrame, name: str = "row_number", first: int = 2) -> DataFrame:
    """Consecutive line numbers in the frame's current order, without a global sort.

    Per-partition counts (one small aggregate, one row per partition) give
    each partition its offset; the offsets are broadcast -- their number is
    bounded by the partition count -- and added to the position in the partition.
    """
    tagged = df.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_base"))
    from pyspark.sql import Window
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    j = tagged.join(F.broadcast(offs.select("_pid", "_off", "_base")), "_pid")
    return j.withColumn(name, (C("_off") + (C("_mid") - C("_base")) + F.lit(first)).cast("long")) \
            .drop("_pid", "_mid", "_off", "_base")
