"""Filters over captured tables. A run's date or time is always a parameter, so that a query can be run again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def on_day(at: Column, run_date: str, days_before: int = 1) -> Column:
    """Whether a time is on the day so many days before a run; a range, so that it reaches a scan's statistics."""
    first = F.date_sub(F.lit(run_date).cast("date"), days_before)
    return (at >= first.cast("timestamp_ntz")) & (at < F.date_add(first, 1).cast("timestamp_ntz"))


def after_day(at: Column, day: str) -> Column:
    """Whether a time is on a later day."""
    return at >= F.date_add(F.lit(day).cast("date"), 1).cast("timestamp_ntz")


def between_days(at: Column, first: str, last: str) -> Column:
    """Whether a time is on one of the days from first to last."""
    return (at >= F.lit(first).cast("timestamp_ntz")) & ~after_day(at, last)


def since_clock(at: Column, run_date: str, clock: str, days_before: int = 1) -> Column:
    """Whether a time is later than a time of day, so many days before a run."""
    return at > (F.to_timestamp_ntz(F.lit(f"{run_date} {clock}"), F.lit("yyyy-MM-dd HH:mm")) - F.expr(f"INTERVAL '{days_before}' DAY"))


def given_up(offline_count: Column, first_online: Column, last_updated: Column, run_date: str, days: int = 4, failures: int = 3) -> Column:
    """Whether something that was online has failed often enough, not longer than so many days ago."""
    return (offline_count >= failures) & first_online.isNotNull() & (last_updated >= F.date_sub(F.lit(run_date).cast("date"), days).cast("timestamp_ntz"))


def not_yet_on(last_updated: Column, run_date: str) -> Column:
    """Whether something hasn't been processed on a run's day, or ever."""
    return last_updated.isNull() | (last_updated < F.lit(run_date).cast("timestamp_ntz"))


def has_any(array: Column, *values: str) -> Column:
    """Whether an array has one of the values."""
    return F.coalesce(F.arrays_overlap(array, F.array(*map(F.lit, values))), F.lit(False))


#: What local files' addresses contain.
LOCAL_FILES = ("file://", "/C:")


def not_a_local_file(uri: Column) -> Column:
    return ~uri.contains(LOCAL_FILES[0]) & ~uri.contains(LOCAL_FILES[1])


def is_malicious(polarity: Column) -> Column:
    """Whether a hand-made label means yes: yes, or undecided."""
    return polarity.isin("yes", "--")
