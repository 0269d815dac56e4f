"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import pytest

from keelson.plans.registry import load_all
from tools.oracle_check import rows_of, type_mismatches

from .conftest import SF_SMALL

QUERIES, ORACLES = load_all()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLES[name])
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)
    assert type_mismatches(df, duck.sql(ORACLES[name])) == []


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert "process_health_status" not in df.columns
    assert df.count() > 0
