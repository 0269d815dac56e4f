"""Time helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# An ISO-8601 date, or date and time with optional fraction and zone; shorter forms such as a bare
# time or a bare year are not dates.
ISO_TIME = (r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?( ?([Zz]|[+-]\d{2}(:?\d{2})?))?)?$")


def iso_timestamp(text: Column) -> Column:
    """Instant of an ISO-8601 text as UTC wall time; without a zone it is UTC whatever the session's; else NULL."""
    v = F.regexp_replace(F.trim(text), r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(?!:)", "$1:00")     # seconds may be left out
    zoned = v.rlike(r"([Zz]|[+-]\d{2}(:?\d{2})?)$") & (F.length(v) > 10)
    at = F.try_to_timestamp(F.when(v.rlike(ISO_TIME), F.when(zoned, v).when(F.length(v) > 10, F.concat(v, F.lit("Z")))
                                   .otherwise(F.concat(v, F.lit("T00:00:00Z")))))
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))


def epoch_micros(ts: Column) -> Column:
    """Whole microseconds since the epoch (keeps fractions that seconds would drop)."""
    return F.unix_micros(ts.cast("timestamp"))


def plus_hours(ts: Column, hours) -> Column:
    h = hours if isinstance(hours, Column) else F.lit(int(hours))
    return ts + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), h.cast("int"), F.lit(0), F.lit(0))


def plus_minutes(ts: Column, minutes) -> Column:
    m = minutes if isinstance(minutes, Column) else F.lit(int(minutes))
    return ts + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), m.cast("int"), F.lit(0))
