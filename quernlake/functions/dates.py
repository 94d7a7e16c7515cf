"""Dates and times beside Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_time_zone(utc: Column, zone: str) -> Column:
    """What clocks in a zone show at an instant that is given as UTC, without a zone."""
    return F.from_utc_timestamp(utc.cast("timestamp"), zone).cast("timestamp_ntz")


def age(later: Column, earlier: Column) -> Column:
    """Years, months and days from one date to a later one: whole months first, then the days that are left."""
    a, b = later.cast("date"), earlier.cast("date")
    months = (F.year(a) * 12 + F.month(a)) - (F.year(b) * 12 + F.month(b))
    months = months - (F.add_months(b, months) > a).cast("int")
    return F.struct((months / 12).cast("int").alias("years"), (months % 12).alias("months"), F.date_diff(a, F.add_months(b, months)).alias("days"))


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Whether two periods share an instant: each has its start, not its end, unless the two are one."""
    return (start_a == start_b) | (start_a < end_b) & (start_b < end_a)
