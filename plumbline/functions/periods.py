"""Calendar periods of timestamps: day, ISO week, month, year."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

GRANULARITIES = ("day", "week", "month", "year")


def checked(granularity: str) -> str:
    if granularity not in GRANULARITIES:
        raise ValueError(f"unknown granularity {granularity!r}; one of {', '.join(GRANULARITIES)}")
    return granularity


def start_of(granularity: str, ts: Column) -> Column:
    return F.date_trunc(checked(granularity), ts).cast("timestamp_ntz")


def end_of(granularity: str, start: Column) -> Column:
    return (start + F.expr(f"INTERVAL 1 {checked(granularity).upper()}")).cast("timestamp_ntz")


def key_of(granularity: str, start: Column) -> Column:
    if checked(granularity) == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), start).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(start).cast("string"), 2, "0"))
    return F.date_format(start, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[granularity])


def lookback(now: datetime, *, days: float | None = None, weeks: float | None = None, months: int | None = None, years: int | None = None) -> datetime | None:
    """The start of a window that ends now, or None if no length is given; a missing day becomes the month's last."""
    if not any((days, weeks, months, years)):
        return None
    count = now.year * 12 + now.month - 1 - int(months or 0) - 12 * int(years or 0)
    year, month = divmod(count, 12)
    last = (datetime(year + (month == 11), (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return now.replace(year=year, month=month + 1, day=min(now.day, last)) - timedelta(days=float(days or 0) + 7 * float(weeks or 0))
