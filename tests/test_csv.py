"""CSV cases from FIXTURES.md A6, written to a fresh temp folder."""

import tempfile

from keelson.sources import csv


def _write(text, name="f.csv"):
    d = tempfile.mkdtemp(prefix="keelson-csv-")
    with open(f"{d}/{name}", "w", encoding="utf-8") as fh:
        fh.write(text)
    return f"{d}/{name}"


def test_names():
    assert csv.unique_identifiers(["Order ID", "order-id", "2024 total", "!!!", ""]) == \
        ["order_id", "order_id_2", "col_2024_total", "column", "column_2"]


def test_delimiters(spark):
    assert csv.sniff_delimiter("a;b;c\n1;2;3") == ";"
    assert csv.sniff_delimiter("a\tb\n") == "\t"
    assert csv.sniff_delimiter("a|b|c\n") == "|"
    assert csv.sniff_delimiter("only\n1\n") == ","
    p = _write("﻿A|B\n1|x\n")
    df = csv.csv_source(spark, p)
    assert df.columns == ["a", "b"] and df.count() == 1


def test_quoting_and_types(spark):
    text = ('flag,bits,n,x,ts,txt,blank\n'
            'yes,0,1,1.5,2024-01-01T00:00:00Z,"a ""q"", b",\n'
            'no,1,-2,1e3,2024-01-02,"line\nbreak",\n'
            'Yes,1,3,.5,2024-01-03 10:00:00,plain,  \n')
    df = csv.csv_source(spark, _write(text))
    assert df.count() == 3
    types = {r.column_name: (r.data_type, r.nullable) for r in csv.infer_types(df).collect()}
    assert types == {"flag": ("BOOLEAN", False), "bits": ("BOOLEAN", False), "n": ("BIGINT", False),
                     "x": ("DOUBLE PRECISION", False), "ts": ("TIMESTAMPTZ", False), "txt": ("TEXT", False),
                     "blank": ("TEXT", True)}
    assert df.where("txt like 'a \"q\"%'").count() == 1


def test_rejects_and_counts(spark):
    text = "id,ok,big\nabc,maybe,1\n5,yes,123456789012345678901\n6,,\n"
    df = csv.with_line_numbers(csv.csv_source(spark, _write(text)))
    acc, rej = csv.typed_load(df, {"id": "BIGINT", "ok": "BOOLEAN", "big": "BIGINT"}, "row_number")
    assert acc.count() + rej.count() == df.count() == 3
    r = {x.row_number: x.reason for x in rej.collect()}
    assert set(r) == {2, 3}
    assert "id: invalid BIGINT" in r[2] and "ok: invalid BOOLEAN" in r[2]
    assert "big: invalid BIGINT" in r[3]  # over 64 bits
    row = acc.collect()[0]
    assert row.id == 6 and row.ok is None and row.big is None  # blank -> NULL, not a reject


def test_line_numbers_are_consecutive_across_partitions(spark):
    df = spark.range(0, 1000, numPartitions=7).withColumnRenamed("id", "v")
    out = csv.with_line_numbers(df).collect()
    nums = sorted(r.row_number for r in out)
    assert nums == list(range(2, 1002))  # first data line is 2
    assert all(r.row_number == r.v + 2 for r in out)  # follows the frame's order
