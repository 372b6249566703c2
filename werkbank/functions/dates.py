"""Date arguments and buckets. Every relative date is relative to an explicit ``as_of``."""

from __future__ import annotations

import calendar
import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column, functions as F

GRAINS = ("day", "week", "month", "year", "total")


def as_date(value: date | str | None, end: bool = False, as_of: date | None = None) -> date | None:
    """A date argument: a date, ISO text, ``YYYY-MM`` (first or last day), blank for none,
    or ``today`` / ``yesterday`` / ``NdaysAgo`` relative to ``as_of``."""
    if value is None or isinstance(value, date) and not isinstance(value, datetime):
        return value
    if isinstance(value, datetime):
        return value.date()
    text = value.strip()
    if not text:
        return None
    if as_of is not None:
        if text == "today":
            return as_of
        if text == "yesterday":
            return as_of - timedelta(days=1)
        days = re.fullmatch(r"(\d+)daysAgo", text)
        if days:
            return as_of - timedelta(days=int(days.group(1)))
    elif end and text.casefold() in ("today", "now", "current date"):
        return None
    month = re.fullmatch(r"(\d{4})-(\d{2})", text)
    if month:
        year, number = int(month.group(1)), int(month.group(2))
        if not 1 <= number <= 12:
            raise ValueError(f"invalid month: {value}")
        return date(year, number, calendar.monthrange(year, number)[1] if end else 1)
    return date.fromisoformat(text)


def date_bounds(date_from, date_to, as_of: date | None = None) -> tuple[date | None, date | None]:
    lo, hi = as_date(date_from, as_of=as_of), as_date(date_to, end=True, as_of=as_of)
    if lo and hi and lo > hi:
        raise ValueError(f"the period ends ({hi}) before it begins ({lo})")
    return lo, hi


def at(moment: datetime | date) -> Column:
    """A wall-clock literal, the same in every session time zone."""
    if not isinstance(moment, datetime):
        moment = datetime(moment.year, moment.month, moment.day)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def date_range(column: Column, lo: date | None, hi: date | None) -> Column:
    """Both days inclusive on a timestamp: from the first midnight to before the day after.
    The bounds are literals, so the comparison reaches the scan."""
    condition = F.lit(True)
    if lo is not None:
        condition = condition & (column >= at(lo))
    if hi is not None and hi < date.max:
        condition = condition & (column < at(hi + timedelta(days=1)))
    return condition


def bucket(column: Column, grain: str) -> Column:
    """First day of the period (Monday for weeks); NULL for ``total``."""
    if grain not in GRAINS:
        raise ValueError(f"no such period: {grain!r}; there are {', '.join(GRAINS)}")
    if grain == "total":
        return F.lit(None).cast("date")
    return F.to_date(column) if grain == "day" else F.date_trunc(grain, column).cast("date")
