"""Date arithmetic as Column expressions (zone-free on TIMESTAMP_NTZ)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def floor_days(start: Column, end: Column) -> Column:
    """Whole elapsed 24-hour periods from ``start`` to ``end``, floored
    (timedelta ``.days``), not calendar-day boundaries crossed."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.floor(micros / F.lit(float(MICROS_PER_DAY))).cast("bigint")


def day(ts: Column) -> Column:
    """Truncate to the calendar day."""
    return F.to_date(ts)


def day_diff(start_day: Column, end_day: Column) -> Column:
    """Calendar days between two dates."""
    return F.datediff(end_day, start_day)


def plus_days(ts: Column, n: int) -> Column:
    return ts + F.expr(f"INTERVAL {int(n)} DAYS")
