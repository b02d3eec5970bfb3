"""Date and period expressions, all relative to an explicit run date ``as_of``.

Predicates are written as ranges on the raw date column so Catalyst can push
them into the Parquet / JDBC scan (``year(d) = y`` or ``datediff(...) < n``
would not be pushed).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(value: str | _dt.date | Column) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = _dt.date.fromisoformat(value)
    return F.lit(value)


def to_pydate(value: str | _dt.date) -> _dt.date:
    return _dt.date.fromisoformat(value) if isinstance(value, str) else value


def period_of_kind(kind: Column, date: str | Column = "date") -> Column:
    """Period number where the kind is itself a column."""
    d = F.col(date) if isinstance(date, str) else date
    return (
        F.when(kind == "month", F.month(d))
        .when(kind == "week", F.weekofyear(d))
        .otherwise(F.year(d))
    )


def in_year_of(date: str | Column, as_of: str | _dt.date) -> Column:
    """``year(date) = year(as_of)`` as a pushable range."""
    d = F.col(date) if isinstance(date, str) else date
    y = to_pydate(as_of).year
    return (d >= F.lit(_dt.date(y, 1, 1))) & (d < F.lit(_dt.date(y + 1, 1, 1)))


def not_after(date: str | Column, as_of: str | _dt.date) -> Column:
    d = F.col(date) if isinstance(date, str) else date
    return d <= F.lit(to_pydate(as_of))


def within_days(date: str | Column, as_of: str | _dt.date, days: int) -> Column:
    """``datediff(as_of, date) < days`` (future dates pass), as a pushable range."""
    d = F.col(date) if isinstance(date, str) else date
    return d > F.lit(to_pydate(as_of) - _dt.timedelta(days=days))


def weeks_before(as_of: str | _dt.date | Column, weeks: int | Column) -> Column:
    """``as_of - weeks`` as a date; ``weeks`` may be a per-region column."""
    w = weeks if isinstance(weeks, Column) else F.lit(weeks)
    return F.date_sub(as_date(as_of), (w * 7).cast("int"))


def previous_month_bounds(as_of: str | _dt.date) -> tuple[_dt.datetime, _dt.datetime]:
    """[first instant of the previous calendar month, first instant of this month). Works in January."""
    d = to_pydate(as_of)
    this_month = _dt.datetime(d.year, d.month, 1)
    prev = _dt.datetime(d.year - 1, 12, 1) if d.month == 1 else _dt.datetime(d.year, d.month - 1, 1)
    return prev, this_month
