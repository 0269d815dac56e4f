"""Typed loading queries (L2, L5) over a text projection of ``orders``, with oracles.

The driver tables are typed parquet, so the loaders run on the text form
of a whole table -- the shape a delimited file arrives in -- plus three
text columns that exercise the word and reject rules.  Line numbers are
``o_orderkey + 2`` (the file is in key order in this binding).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keelson.plans.registry import query
from keelson.session import scratch_path
from keelson.sources import csv, records

C = F.col

_TEXT = [("o_orderkey", "cast(o_orderkey as string)"), ("o_custkey", "cast(o_custkey as string)"),
         ("o_orderstatus", "o_orderstatus"), ("o_totalprice", "cast(o_totalprice as string)"),
         ("o_orderdate", "cast(o_orderdate as string)"), ("o_orderpriority", "o_orderpriority"),
         ("flag", "CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'no' ELSE ' ' END"),
         ("bits", "cast(o_orderkey % 2 as string)"),
         ("mixed", "CASE WHEN o_orderkey % 50 = 7 THEN 'abc' WHEN o_orderkey % 50 = 9 THEN '' "
                   "ELSE cast(o_orderkey * 3 as string) END")]
TEXT_SQL = "SELECT " + ", ".join(f"{e.replace('as string', 'AS VARCHAR')} AS {n}" for n, e in _TEXT) + \
           ", o_orderkey + 2 AS line_no FROM orders"


def text_orders(r):
    return r.table("orders").selectExpr(*[f"{e} AS {n}" for n, e in _TEXT], "o_orderkey + 2 AS line_no")


def _infer_sql():
    parts = []
    for i, (n, _) in enumerate(_TEXT):
        v = f"CASE WHEN length(trim({n})) > 0 THEN trim({n}) END"
        boolw = ", ".join(f"'{w}'" for w in csv.BOOLEAN_WORDS)
        floatw = ", ".join(f"'{w}'" for w in csv.FLOAT_WORDS)
        b = f"bool_and(COALESCE(lower({v}) IN ({boolw}), TRUE))"
        it = f"bool_and(COALESCE(regexp_matches({v}, '{csv.INT_RE}'), TRUE))"
        fl = f"bool_and(COALESCE(regexp_matches({v}, '{csv.FLOAT_RE}') OR lower({v}) IN ({floatw}), TRUE))"
        ts = f"bool_and(COALESCE({v} IS NULL OR TRY_CAST({v} AS TIMESTAMP) IS NOT NULL, TRUE))"
        parts.append(f"""SELECT '{n}' AS column_name,
  CASE WHEN COUNT({v}) = 0 THEN 'TEXT' WHEN {b} THEN 'BOOLEAN' WHEN {it} THEN 'BIGINT'
       WHEN {fl} THEN 'DOUBLE PRECISION' WHEN {ts} THEN 'TIMESTAMPTZ' ELSE 'TEXT' END AS data_type,
  (COUNT({v}) <> COUNT(*) OR COUNT({v}) = 0) AS nullable, {i} AS ordinal FROM t""")
    return f"WITH t AS ({TEXT_SQL})\n" + "\nUNION ALL\n".join(parts)


@query("infer_types", _infer_sql())
def q_infer_types(r):
    """L2 column types inferred from every row of the text table."""
    return csv.infer_types(text_orders(r).drop("line_no"))


MAPPING = {"o_orderkey": "BIGINT", "o_custkey": "INTEGER", "o_totalprice": "NUMERIC",
           "o_orderdate": "TIMESTAMPTZ", "flag": "BOOLEAN", "mixed": ("mixed_id", "BIGINT"),
           "o_orderstatus": "TEXT"}


def _load(r):
    return csv.typed_load(text_orders(r), MAPPING, "line_no")


_V = lambda n: f"CASE WHEN length(trim({n})) > 0 THEN trim({n}) END"
LOADED_SQL = f"""
WITH t AS ({TEXT_SQL}),
x AS (SELECT line_no AS row_number,
             CASE WHEN regexp_matches({_V('o_orderkey')}, '{csv.INT_RE}') THEN TRY_CAST({_V('o_orderkey')} AS BIGINT) END AS o_orderkey,
             CASE WHEN regexp_matches({_V('o_custkey')}, '{csv.INT_RE}') THEN TRY_CAST({_V('o_custkey')} AS INTEGER) END AS o_custkey,
             CASE WHEN regexp_matches({_V('o_totalprice')}, '{csv.FLOAT_RE}') THEN TRY_CAST({_V('o_totalprice')} AS DOUBLE) END AS o_totalprice,
             TRY_CAST({_V('o_orderdate')} AS TIMESTAMP) AS o_orderdate,
             CASE WHEN lower({_V('flag')}) IN ('true', 'yes', '1') THEN TRUE
                  WHEN lower({_V('flag')}) IN ('false', 'no', '0') THEN FALSE END AS flag,
             CASE WHEN regexp_matches({_V('mixed')}, '{csv.INT_RE}') THEN TRY_CAST({_V('mixed')} AS BIGINT) END AS mixed_id,
             {_V('o_orderstatus')} AS o_orderstatus,
             {_V('mixed')} AS mixed_text,
             CAST(json_object('o_orderkey', o_orderkey, 'o_custkey', o_custkey, 'o_orderstatus', o_orderstatus,
                  'o_totalprice', o_totalprice, 'o_orderdate', o_orderdate, 'o_orderpriority', o_orderpriority,
                  'flag', flag, 'bits', bits, 'mixed', mixed) AS VARCHAR) AS original_row
      FROM t)
"""


@query("typed_load_accepted", LOADED_SQL + """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, flag, mixed_id, o_orderstatus FROM x
WHERE NOT (mixed_text IS NOT NULL AND mixed_id IS NULL)
""")
def q_typed_load_accepted(r):
    """L5 rows that convert under the mapping (blank -> NULL)."""
    return _load(r)[0]


@query("typed_load_rejected", LOADED_SQL + """
SELECT row_number, 'mixed_id: invalid BIGINT value "' || mixed_text || '"' AS reason, original_row FROM x
WHERE mixed_text IS NOT NULL AND mixed_id IS NULL
""")
def q_typed_load_rejected(r):
    """L5 rejected rows with line number, reason and the original values."""
    return _load(r)[1]


# --------------------------------------------------------------------- L1 on split files
FILE_ROWS = 500             # documents of one written file
_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def written_documents(r) -> str:
    """All documents as delimited files with a header, one per FILE_ROWS ids; every 97th has a field too many."""
    path = scratch_path(r.spark, f"documents-csv-{uuid.uuid4().hex}")
    d = r.table("documents").withColumn("chunk", F.expr(f"doc_id div {FILE_ROWS}"))
    line = F.to_csv(F.struct(*_FIELDS), {"quoteAll": "true", "escape": '"', "lineSep": "\n", "charToEscapeQuoteEscaping": '"'})
    rows = d.select("chunk", C("doc_id").alias("at"),
                    F.concat(line, F.when(C("doc_id") % 97 == 0, F.lit(",more")).otherwise(F.lit(""))).alias("value"))
    heads = d.select("chunk").distinct().select("chunk", F.lit(-1).cast("long").alias("at"), F.lit(",".join(_FIELDS)).alias("value"))
    (rows.union(heads).repartition("chunk").sortWithinPartitions("chunk", "at").select("chunk", "value")
     .write.option("lineSep", "\n").partitionBy("chunk").text(path))
    return path


_PLACED = f"""
placed AS (
  SELECT *, 2 + coalesce(sum(1 + length(text) - length(replace(text, chr(10), ''))) OVER (
             PARTITION BY doc_id // {FILE_ROWS} ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS row_number
  FROM documents)"""


@query("csv_split_rows", f"""
WITH {_PLACED}
SELECT CAST(row_number AS BIGINT) AS row_number, doc_id, source, lang, n_chars, nullif(text, '') AS text
FROM placed WHERE doc_id % 97 <> 0
""")
def q_csv_split_rows(r):
    """L1/L5 documents read back from split files: fields with quotes and line ends, and the line each row starts on."""
    rows, _ = records.split_csv(r.spark, f"{written_documents(r)}/*/*.txt")
    return rows.select("row_number", C("doc_id").cast("long").alias("doc_id"), "source", "lang",
                       C("n_chars").cast("long").alias("n_chars"), "text")


@query("csv_split_rejected", f"""
WITH {_PLACED}
SELECT CAST(row_number AS BIGINT) AS row_number, 'Row has more or fewer fields than the header.' AS reason,
       concat('"', doc_id, '","', source, '","', lang, '","', n_chars, '","', replace(text, '"', '""'), '",more') AS original_row
FROM placed WHERE doc_id % 97 = 0
""")
def q_csv_split_rejected(r):
    """L5 ragged rows with the file line they start on and their whole text."""
    _, rejected = records.split_csv(r.spark, f"{written_documents(r)}/*/*.txt")
    return rejected.select("row_number", "reason", "original_row")
