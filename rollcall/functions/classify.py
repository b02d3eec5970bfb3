"""Event classifiers as Spark ``Column`` expressions (no UDFs).

The source patterns are written for a regex engine where ``.`` stops only at
``\\n`` and ``\\s`` is Unicode white space. Java needs the ``d`` (UNIX_LINES)
and ``U`` (UNICODE_CHARACTER_CLASS) flags for the same behaviour.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.constants import (
    AO_NOT_WORKOUT_PATTERN,
    AO_QSOURCE_PATTERN,
    BACKBLAST_PREFIX_CHARS,
    BACKBLAST_QSOURCE_PATTERN,
)

_FLAGS = "(?dU)"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def matches(text: str | Column, pattern: str) -> Column:
    """Regex *search* (not full match) with the source engine's semantics. NULL in, NULL out."""
    return _col(text).rlike(_FLAGS + pattern)


def backblast_is_qsource(backblast: str | Column = "backblast") -> Column:
    """Three-valued: does the first 100 characters of the write-up look like a QSource lesson."""
    head = F.lower(F.substring(_col(backblast), 1, BACKBLAST_PREFIX_CHARS))
    return matches(head, BACKBLAST_QSOURCE_PATTERN)


def ao_is_qsource(ao: str | Column = "ao") -> Column:
    return matches(F.lower(_col(ao)), AO_QSOURCE_PATTERN)


def ao_is_not_workout(ao: str | Column = "ao") -> Column:
    return matches(F.lower(_col(ao)), AO_NOT_WORKOUT_PATTERN)


def is_qsource(backblast: str | Column = "backblast", ao: str | Column = "ao") -> Column:
    """Row passes the QSource filter (``bb OR ao`` under Kleene logic, NULL counted as not passing)."""
    return F.coalesce(backblast_is_qsource(backblast) | ao_is_qsource(ao), F.lit(False))


def is_workout(backblast: str | Column = "backblast", ao: str | Column = "ao") -> Column:
    """Row passes the workout filter (``NOT bb AND NOT ao`` under Kleene logic, NULL counted as not passing)."""
    return F.coalesce(~backblast_is_qsource(backblast) & ~ao_is_not_workout(ao), F.lit(False))


def event_class(backblast: str | Column = "backblast", ao: str | Column = "ao") -> Column:
    """'qsource', 'workout' or 'other' (neither filter passes, e.g. NULL write-up at a workout site)."""
    return (
        F.when(is_qsource(backblast, ao), F.lit("qsource"))
        .when(is_workout(backblast, ao), F.lit("workout"))
        .otherwise(F.lit("other"))
    )
