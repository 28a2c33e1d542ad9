"""Time arithmetic on TIMESTAMP and TIMESTAMP_NTZ columns alike (session zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MINUTE_US = 60_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch as BIGINT; the order key of every chunk and frame."""
    return F.unix_micros(col(c).cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def minutes_between(later: Column | str, earlier: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(MINUTE_US))


def plus_minutes(c: Column | str, minutes: Column | int) -> Column:
    m = minutes if isinstance(minutes, Column) else F.lit(minutes)
    return col(c) + F.make_dt_interval(mins=m.cast("int"))


def floor_minutes(c: Column | str, minutes: int) -> Column:
    """Left edge of the civil grid cell of ``minutes`` length."""
    width = minutes * MINUTE_US
    return from_micros(F.floor(micros(c) / F.lit(width)) * F.lit(width))


def civil_to_utc(c: Column | str, zone: str) -> Column:
    """Wall clock of a source zone to UTC wall clock."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), col(c).cast("timestamp_ntz"))


def month_key(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM")
