"""Portable rounding/formatting of DOUBLE values.

``round(double)`` differs between engines at ties (decimal text vs binary
value), and ``%.1f`` formatting differs too (half-up vs half-even on the
binary value).  ``floor(x * 10^d + 0.5) / 10^d`` is the same IEEE operation
sequence everywhere, so the result is bit-identical across engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int) -> Column:
    scale = float(10 ** digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def sql_round_half_up(x: str, digits: int) -> str:
    scale = float(10 ** digits)
    return f"(CAST(floor(({x}) * {scale} + 0.5) AS DOUBLE) / {scale})"
