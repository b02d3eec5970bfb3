"""String building as Column expressions: templates, ordinals, mention targets."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill(template: str, **values: Column | str) -> Column:
    """Fill a ``str.format`` style template with Columns (or Python strings) into one ``concat``.

    Only plain ``{name}`` fields are supported. A NULL value makes the whole
    text NULL, like ``concat``.
    """
    parts: list[Column] = []
    for literal, field, spec, conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            if spec or conv:
                raise ValueError("format specs are not supported")
            v = values[field]
            parts.append(F.lit(v) if isinstance(v, str) else v.cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def ordinal_suffix(n: Column) -> Column:
    """English ordinal suffix: 1st 2nd 3rd 4th ... 11th 12th 13th ... 21st."""
    r100 = F.pmod(n, F.lit(100))
    r10 = F.pmod(n, F.lit(10))
    return (
        F.when(r100.between(11, 13), F.lit("th"))
        .when(r10 == 1, F.lit("st"))
        .when(r10 == 2, F.lit("nd"))
        .when(r10 == 3, F.lit("rd"))
        .otherwise(F.lit("th"))
    )


def mention_target(recipient: Column) -> Column:
    """``@<id>`` for a user id (first character 'U', any case), otherwise ``!channel``; NULL/empty -> ``!channel``."""
    return F.when(
        F.upper(F.substring(recipient, 1, 1)) == F.lit("U"), F.concat(F.lit("@"), recipient)
    ).otherwise(F.lit("!channel"))
