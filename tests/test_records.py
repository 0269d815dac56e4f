"""Records of split files: the same rows and lines however small the splits are."""

import csv as pycsv
import io
import random
import tempfile

import pytest

from keelson.sources import records


def _write(text):
    d = tempfile.mkdtemp(prefix="keelson-records-")
    with open(f"{d}/f.csv", "w", encoding="utf-8", newline="") as fh:
        fh.write(text)
    return f"{d}/f.csv"


@pytest.fixture(params=["128m", "4k", "64"])
def split_size(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def test_fields_lines_and_rejects(spark, split_size):
    text = ('﻿Id,"Big, Name",text\r\n1,a,"x ""y"" z"\r\n2,b,"line one\nline, two\n\nfour"\r\n\r\n3,c\r\n4,d,e,f\r\n'
            '5,,plain\r\n6,g,"never closed\nmore\n')
    rows, rejected = records.split_csv(spark, _write(text))
    assert rows.columns == ["row_number", "id", "big_name", "text"]
    assert sorted(map(tuple, rows.collect())) == [(2, "1", "a", 'x "y" z'), (3, "2", "b", "line one\nline, two\n\nfour"),
                                                  (10, "5", None, "plain")]
    got = sorted((r.row_number, r.reason, r.original_row) for r in rejected.collect())
    assert got == [(8, records.FIELDS_REASON, "3,c"), (9, records.FIELDS_REASON, "4,d,e,f"),
                   (11, records.OPEN_REASON, '6,g,"never closed\nmore')]


def test_one_file_read_by_many_tasks(spark, split_size):
    r = random.Random(3)
    rows = [(str(i), "".join(r.choice('ab,"\n x') for _ in range(r.randrange(60))) + "|", str(r.random())) for i in range(3000)]
    out = io.StringIO()
    w = pycsv.writer(out, lineterminator="\n")
    w.writerow(["n", "text", "x"])
    at, wanted = 2, []
    for row in rows:
        wanted.append((at, *row))
        at += 1 + row[1].count("\n")
        w.writerow(row)
    path = _write(out.getvalue())
    got, rejected = records.split_csv(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(wanted) and rejected.count() == 0
    if split_size == "4k":
        assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 10


def test_unclosed_quote_does_not_gather_the_file(spark):
    path = _write('a,b\n1,"open\n' + "2,x\n" * 5000)
    rows, rejected = records.split_csv(spark, path, most_lines=100)
    (bad,) = rejected.collect()
    assert rows.count() == 0 and bad.row_number == 2 and bad.original_row.count("\n") == 99


def test_empty_files(spark):
    for text in ("", "a,b\n", "a,b"):
        rows, rejected = records.split_csv(spark, _write(text))
        assert rows.count() == 0 and rejected.count() == 0
