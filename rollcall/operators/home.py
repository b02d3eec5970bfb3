"""Home region of every person: look-back attendance ladder and arg-max.

The source joins four correlated look-back sub-queries (30/60/90/120 days) back
onto the year's attendance. Here all five counts come out of one conditional
aggregate per (region, email): one pass, one partially-aggregated shuffle.
The arg-max over regions packs the attendance and the region's number in name
order into one long, whose maximum is a hash aggregate (a buffer of strings
would be sorted instead); ties resolve the same way every run: larger region
name, then user id.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.constants import HOME_LOOKBACK_DAYS
from rollcall.functions import periods


def lookback_start(as_of: _dt.date | str, lookbacks: Sequence[int] = HOME_LOOKBACK_DAYS) -> _dt.date:
    """Earliest event date that can count for ``as_of``: 1 January, or the start of the longest look-back."""
    d = periods.to_pydate(as_of)
    return min(_dt.date(d.year, 1, 1), d - _dt.timedelta(days=max(lookbacks) - 1))


def _lookback_counts(att: DataFrame, as_of, lookbacks: Sequence[int], keys: list[str]) -> DataFrame:
    as_of = periods.to_pydate(as_of)
    in_year = periods.in_year_of("bd_date", as_of)
    windows = [periods.within_days("bd_date", as_of, n) for n in lookbacks]
    # only rows that can count anywhere: a pushable range on bd_date
    relevant = in_year
    for w in windows:
        relevant = relevant | w
    aggs = [F.count(F.when(in_year, F.lit(1))).alias("ytd")]
    aggs += [F.count(F.when(w, F.lit(1))).alias(f"c{n}") for w, n in zip(windows, lookbacks)]
    return att.where(relevant).groupBy(*keys).agg(*aggs)


def _ladder(lookbacks: Sequence[int]):
    return F.coalesce(*[F.nullif(F.col(f"c{n}"), F.lit(0)) for n in lookbacks], F.col("ytd"))


def home_region_counts(
    att: DataFrame, as_of: _dt.date | str, lookbacks: Sequence[int] = HOME_LOOKBACK_DAYS
) -> DataFrame:
    """Per (region, email) attendance = first non-zero look-back count, else the year-to-date count.

    ``att`` has (region, email, bd_date) rows (``attendance_fact``). Only people
    with a post in the calendar year of ``as_of`` appear. Look-backs are not
    bounded by the year and admit future dates. A NULL email never matches the
    look-back sub-queries in the source, so it always gets the year count.
    Columns: region, email, attendance (bigint).
    """
    c = _lookback_counts(att, as_of, lookbacks, ["region", "email"])
    attendance = F.when(F.col("email").isNull(), F.col("ytd")).otherwise(_ladder(lookbacks))
    return c.where(F.col("ytd") > 0).select("region", "email", attendance.alias("attendance"))


def home_region_counts_by_user(
    att: DataFrame, as_of: _dt.date | str, lookbacks: Sequence[int] = HOME_LOOKBACK_DAYS
) -> DataFrame:
    """U3 (report variant): per (region, email, user_id); look-back counts per email, year count per user id.

    The per-email sums are a window over the already aggregated (region, email)
    groups, whose size is the number of accounts of one person in one region.
    Columns: region, email, user_id, attendance (bigint).
    """
    c = _lookback_counts(att, as_of, lookbacks, ["region", "email", "user_id"])
    # NULL emails use the year count only; keep each such account in its own partition
    # instead of gathering all of a region's NULL-email accounts into one window group
    per_email = Window.partitionBy("region", "email", F.when(F.col("email").isNull(), F.col("user_id")))
    for n in lookbacks:
        c = c.withColumn(f"c{n}", F.sum(f"c{n}").over(per_email))
    attendance = F.when(F.col("email").isNull(), F.col("ytd")).otherwise(_ladder(lookbacks))
    return c.where(F.col("ytd") > 0).select("region", "email", "user_id", attendance.alias("attendance"))


#: Numbers of names in a packed maximum: 2 ** 20 regions, or sites of a region; the measure has the 43 bits above.
NUMBER_BITS = 20


def numbered(names: DataFrame, name: str, within: str | None = None) -> DataFrame:
    """(within, name, no): the distinct ``name`` values (of each ``within``), numbered from 0 in ascending order.

    For dimensions such as regions and sites, whose distinct values are few;
    more than 2 ** NUMBER_BITS of them fail the run instead of being mixed up.
    """
    keys = [within] if within else []
    order = Window.partitionBy(*keys).orderBy(name)
    no = (F.row_number().over(order) - 1).cast("long")
    checked = F.when(no < (1 << NUMBER_BITS), no).otherwise(F.raise_error(F.lit(f"too many values of {name}")).cast("long"))
    return names.select(*keys, name).distinct().withColumn("no", checked)


def packed(measure: str, no: str = "no") -> Column:
    """A measure and a number as one long that orders by the measure, then by the number."""
    return F.shiftleft(F.col(measure).cast("long"), NUMBER_BITS).bitwiseOR(F.col(no))


def measure_of(value: str) -> Column:
    return F.shiftright(value, NUMBER_BITS)


def number_of(value: str) -> Column:
    return F.col(value).bitwiseAND(F.lit((1 << NUMBER_BITS) - 1))


def pick_home_region(counts: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """U4: the region (and user id, when present) with the greatest attendance per email.

    The maximum of (attendance, region) is a packed long: one hash aggregate
    with map-side partial maxima and one exchange by email. ``regions`` (region) lists the
    regions, if the caller has such a table; else they are taken from
    ``counts``. With a user id the accounts that reach the maximum are
    compared by id, mostly one a person. Ties: larger region name, then user id.
    Columns: email, region[, user_id], attendance.
    """
    no = numbered(counts if regions is None else regions, "region")
    known = counts.join(no, "region").withColumn("v", packed("attendance"))
    if "user_id" not in counts.columns:
        best = known.groupBy("email").agg(F.max("v").alias("v"))
    else:
        accounts = known.groupBy("email", "v").agg(F.max("user_id").alias("user_id"))
        top = known.groupBy("email").agg(F.max("v").alias("top")).withColumnRenamed("email", "e")
        best = accounts.join(top, accounts["email"].eqNullSafe(top["e"]) & (accounts["v"] == top["top"]))
    users = ["user_id"] if "user_id" in counts.columns else []
    named = best.withColumn("no", number_of("v")).join(no, "no")
    return named.select("email", "region", measure_of("v").alias("attendance"), *users)
