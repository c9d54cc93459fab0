"""Column expressions on clock times. None of them goes through the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"


def clock_text(time: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of a time without zone."""
    return F.substring(time.cast("timestamp_ntz").cast("string"), 1, 19)


def seconds_between(started: Column, ended: Column) -> Column:
    """Seconds from one time without zone to another, with fractions, as a decimal."""
    return (ended - started).cast("interval second").cast("decimal(18,6)")


def as_instant(time: Column) -> Column:
    """The instant at which UTC clocks show the time."""
    return F.timestamp_micros((seconds_between(F.lit(EPOCH).cast("timestamp_ntz"), time) * 1_000_000).cast("bigint"))


def from_instant(instant: Column) -> Column:
    """The time UTC clocks show at an instant."""
    seconds = F.unix_micros(instant) / F.lit(1_000_000).cast("decimal(7,0)")
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
