"""Registry of named queries and their DuckDB oracle SQL.

A query is ``fn(roles) -> DataFrame`` over ``keelson.plans.roles.Roles``; the
registered callable takes ``(spark, sf_dir)``.  Results are normalised for
comparison: DECIMAL columns become DOUBLE (an exact decimal converts to the
same double in both engines).  The oracle SQL gets the role CTEs it names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from keelson.plans.roles import Roles, with_roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BENCH: list[str] = []


def normalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, DecimalType):
            cols.append(F.col(f"`{f.name}`").cast("double").alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def query(name: str, sql: str | None = None, bench: bool = False):
    """Register ``fn(roles)`` as query ``name`` with an optional oracle."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Every operator is written for UTC session time (naive driver
            # timestamps are UTC wall time).
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return normalize(fn(Roles(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_roles(sql)
        if bench:
            BENCH.append(name)
        return fn
    return deco


def load_all():
    """Import every plan module so its queries register."""
    from keelson.plans import (  # noqa: F401
        baseline_plans,
        change_plans,
        chart_plans,
        document_plans,
        event_plans,
        kpi_plans,
        late_plans,
        ledger_plans,
        load_plans,
        restore_plans,
        store_plans,
        stream_plans,
        telemetry_plans,
        upkeep_plans,
    )
    return QUERIES, ORACLES
