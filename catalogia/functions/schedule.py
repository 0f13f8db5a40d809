"""Feed schedules: daily at a local time in a zone, or every so many hours."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _at(day: Column, time: Column, zone: Column) -> Column:
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), time), "yyyy-MM-dd HH:mm"), zone)


def next_run(kind: Column, time: Column, zone: Column, every_hours: Column, now: Column) -> Column:
    """Strictly after now (UTC session). A local time that a clock change skips moves on by the gap; a repeated one is its first occurrence."""
    today = F.to_date(F.from_utc_timestamp(now, zone))
    first = _at(today, time, zone)
    daily = F.when(first > now, first).otherwise(_at(F.date_add(today, 1), time, zone))
    hourly = F.timestamp_seconds(F.unix_micros(now) / 1_000_000 + every_hours * 3600)
    return F.when(kind == "daily", daily).otherwise(hourly)


def feed_backoff(failures: Column, busy: Column, scheduled: Column, now: Column) -> Column:
    """When to try again: after 15 minutes if the supplier is busy, 30 minutes a failure up to three, then the next scheduled run."""
    later = lambda minutes: F.timestamp_seconds(F.unix_seconds(now) + minutes * 60)
    return F.when(busy, later(F.lit(15))).when((failures > 0) & (failures <= 3), later(failures * 30)).otherwise(scheduled)
