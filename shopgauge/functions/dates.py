"""Calendar helpers that stay in DATE (no timestamp or time-zone round trip)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .measures import col_


def iso_weekday(c) -> Column:
    """1 = Monday … 7 = Sunday (PostgreSQL ISODOW)."""
    return F.weekday(col_(c)) + 1


def week_start(c) -> Column:
    """Monday of the date's ISO week (DATE_TRUNC('week') as a DATE)."""
    d = col_(c)
    return F.date_sub(d, F.weekday(d))


def month_start(c) -> Column:
    return F.trunc(col_(c), "month")


def quarter_start(c) -> Column:
    return F.trunc(col_(c), "quarter")


def days_between(later, earlier) -> Column:
    """Integer day difference ``later - earlier`` (PostgreSQL date - date)."""
    return F.datediff(col_(later), col_(earlier))
