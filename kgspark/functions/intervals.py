"""Closed validity intervals [start, end]; a NULL end means still open."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

FAR_FUTURE = dt.date(9999, 12, 31)


def as_date(value: str | dt.date) -> Column:
    return F.lit(dt.date.fromisoformat(value) if isinstance(value, str) else value)


def open_end(end: Column) -> Column:
    """Make an open end comparable; LEAST and < would otherwise lose NULLs."""
    return F.coalesce(end, F.lit(FAR_FUTURE))


def active_as_of(as_of, start: str = "start_date", end: str = "end_date",
                 require_started: bool = False) -> Column:
    """Open, or ending on or after ``as_of``. The start is only tested on request."""
    day = as_date(as_of)
    cond = F.col(end).isNull() | (F.col(end) >= day)
    return cond & (F.col(start) <= day) if require_started else cond


def overlap_start(s1: Column, s2: Column) -> Column:
    return F.greatest(s1, s2)


def overlap_end(e1: Column, e2: Column) -> Column:
    """Least end with open ends as +infinity; NULL again when both are open."""
    least = F.least(open_end(e1), open_end(e2))
    return F.when(least < F.lit(FAR_FUTURE), least)


def tenure_days(start: Column, end: Column, as_of=None) -> Column:
    """Days from start to end; with ``as_of`` open intervals count up to that day."""
    last = F.coalesce(end, as_date(as_of)) if as_of is not None else end
    return F.datediff(last, start)


def in_year(col: Column | str, year: int) -> Column:
    """Year test written as a range so that the scan can use it."""
    c = F.col(col) if isinstance(col, str) else col
    return ((c >= F.lit(dt.datetime(year, 1, 1)).cast("timestamp_ntz"))
            & (c < F.lit(dt.datetime(year + 1, 1, 1)).cast("timestamp_ntz")))


def whole_years(start: Column, as_of) -> Column:
    """Age in completed years on ``as_of``."""
    return F.floor(F.months_between(as_date(as_of), start) / 12).cast("int")
