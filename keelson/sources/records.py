"""Delimited records from large files that are split over tasks.

A quoted field may hold line ends, so where a record begins depends on all quotes before it
in the file.  Every task reads the physical lines of its own split; the lines and quotes of
each split are summed, and the sums of the splits before it tell a split how many lines of
the file precede it and whether it begins inside quotes.  No task reads a whole file, and
every record knows the line of the file it starts on.
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.sources.csv import sniff_delimiter, unique_identifiers

C = F.col
MOST_LINES = 10_000         # physical lines of one record; a longer one is an unclosed quote and is rejected
FIELDS_REASON = "Row has more or fewer fields than the header."
OPEN_REASON = "Quoted field is not closed."
BOM = "﻿"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, id, value, quotes, n, before): physical lines with their place and the quotes before them in their split."""
    read = spark.read.option("lineSep", "\n").text(path).select(
        C("_metadata.file_path").alias("file"), C("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value")
    inside = Window.partitionBy("file", "block").orderBy("id")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return (read.withColumn("quotes", quotes.cast("long")).withColumn("n", F.row_number().over(inside).cast("long"))
            .withColumn("before", F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - C("quotes")))


def split_records(spark: SparkSession, path: str, most_lines: int = MOST_LINES) -> DataFrame:
    """(file, line_no, n_lines, record, closed): one row per record, ``line_no`` the line it starts on (from 1).

    Lines end in LF or CRLF; a byte order mark is dropped, blank lines outside quotes are
    not records.  Any quote counts as opening or closing, so fields that hold one must be
    quoted.  A record of more than ``most_lines`` lines keeps its first ones only and counts
    as not closed.
    """
    lines = _lines(spark, path)
    last = lambda odd: F.max(F.when(C("before") % 2 == odd, C("n")))
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("q"), F.count(F.lit(1)).alias("m"),
                                                last(0).alias("even"), last(1).alias("odd"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"lines_ahead": F.coalesce(F.sum("m").over(ahead), F.lit(0)),
                                 "quotes_ahead": F.coalesce(F.sum("q").over(ahead), F.lit(0))})
    opened = C("lines_ahead") + F.when(C("quotes_ahead") % 2 == 0, C("even")).otherwise(C("odd"))
    blocks = blocks.withColumn("opened", opened).withColumn("open_record", F.max("opened").over(ahead))
    x = lines.join(blocks.select("file", "block", "lines_ahead", "quotes_ahead", "open_record"), ["file", "block"])
    x = x.withColumn("line_no", C("lines_ahead") + C("n")).withColumn("starts", (C("quotes_ahead") + C("before")) % 2 == 0)
    run = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("first", F.coalesce(F.max(F.when(C("starts"), C("line_no"))).over(run), C("open_record")))
    value = F.when(C("line_no") == 1, F.regexp_replace("value", f"^{BOM}", "")).otherwise(C("value"))
    x = x.select("file", "line_no", "first", "quotes", value.alias("value"), (C("starts") & (C("quotes") % 2 == 0)).alias("single"))
    single = x.where("single").select("file", "line_no", F.lit(1).cast("long").alias("n_lines"), C("value").alias("record"),
                                      F.lit(True).alias("closed"))
    kept = F.when(C("line_no") - C("first") < most_lines, F.struct("line_no", "value"))
    many = x.where("not single").withColumn("kept", kept).groupBy("file", "first").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sort_array(F.collect_list("kept")).alias("parts"), F.sum("quotes").alias("q"))
    many = many.select("file", C("first").alias("line_no"), "n_lines", F.array_join(C("parts.value"), "\n").alias("record"),
                       ((C("q") % 2 == 0) & (C("n_lines") <= most_lines)).alias("closed"))
    out = single.unionByName(many).withColumn("record", F.regexp_replace("record", "\r$", ""))
    return out.where((F.trim("record") != "") | ~C("closed"))


def split_csv(spark: SparkSession, path: str, delimiter: str | None = None, row_number: str = "row_number",
              file_name: str | None = None, most_lines: int = MOST_LINES) -> tuple[DataFrame, DataFrame]:
    """L1 on split files: (rows, rejected).

    ``rows`` has the header's columns as text and ``row_number``, the file line a row starts
    on (``file_name`` names a further column with its file).  ``rejected`` has (file,
    row_number, reason, original_row): rows with more or fewer fields than the header, and
    quoted fields that never close.  All files share the header, one line without line ends
    in its names; each file's own first line is left out.
    """
    head = spark.read.option("lineSep", "\n").text(path).limit(1).collect()
    head = head[0][0].lstrip(BOM).rstrip("\r") if head else ""
    sep = delimiter or sniff_delimiter(head)
    wrong = "_wrong_fields"
    names = unique_identifiers(next(csv.reader([head], delimiter=sep), [""]))
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    schema = ", ".join(f"`{x}` string" for x in [*names, wrong])
    records = split_records(spark, path, most_lines).where("line_no > 1")
    parsed = records.withColumn("x", F.when(C("closed"), F.from_csv("record", schema, {**options, "columnNameOfCorruptRecord": wrong})))
    bad = ~C("closed") | C(f"x.{wrong}").isNotNull()
    rows = parsed.where(~bad).select(*([C("file").alias(file_name)] if file_name else []), C("line_no").alias(row_number),
                                     *[C(f"x.`{x}`").alias(x) for x in names])
    rejected = parsed.where(bad).select(
        "file", C("line_no").alias("row_number"),
        F.when(C("closed"), F.lit(FIELDS_REASON)).otherwise(F.lit(OPEN_REASON)).alias("reason"), C("record").alias("original_row"))
    return rows, rejected
