"""Calendar periods in a fixed home zone over instants kept in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ledger's days and months are those of this zone.
HOME_ZONE = "Asia/Colombo"


def home_day(at: Column, zone: str = HOME_ZONE) -> Column:
    """The day in the home zone of an instant."""
    return F.from_utc_timestamp(at, zone).cast("date")


def home_month(at: Column, zone: str = HOME_ZONE) -> Column:
    return F.trunc(home_day(at, zone), "MM")


def day_start(day: Column, zone: str = HOME_ZONE) -> Column:
    """The instant at which a home day begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def within(at: Column, start: Column, end: Column) -> Column:
    """A half-open range of time, in the form that the scan can push down."""
    return (at >= start) & (at < end)


#: Named periods: the unit that they begin with, and how many units before the present one.
NAMED = {"today": ("DAY", 0), "yesterday": ("DAY", 1), "this_month": ("MONTH", 0), "last_month": ("MONTH", 1)}


def period(name: str, now: Column, zone: str = HOME_ZONE) -> tuple[Column, Column]:
    """The instants at which a named period of the home zone begins and ends, its end not in it."""
    if name not in NAMED:
        raise ValueError(f"unknown period: {name}")
    unit, back = NAMED[name]
    day = home_day(now, zone)
    if unit == "DAY":
        first, after = F.date_sub(day, back), F.date_sub(day, back - 1)
    else:
        first, after = F.add_months(F.trunc(day, "MM"), -back), F.add_months(F.trunc(day, "MM"), 1 - back)
    return day_start(first, zone), day_start(after, zone)


def before(start: Column, end: Column) -> tuple[Column, Column]:
    """The period of the same length just before."""
    return F.timestamp_seconds(F.unix_timestamp(start) * 2 - F.unix_timestamp(end)), start


def whole_utc_days(start: Column, end: Column) -> tuple[Column, Column]:
    """The least run of whole UTC days that covers a period, as (first, day after the last)."""
    last = end - F.expr("INTERVAL 1 MICROSECOND")
    return start.cast("date"), F.date_add(last.cast("date"), 1)
