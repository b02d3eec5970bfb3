"""New awards against the award history (U18-U21), for every region in one plan.

The source loops over regions and awards, filters per award and anti-joins
per award. Here the award id and the region are extra join keys: one
null-safe anti join for all regions and awards (planned as an equi join;
``<=>`` keys are hash keys), one semi join with the regions' award lists.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.constants import EXCLUDED_REGIONS_AWARDS
from rollcall.functions import periods
from rollcall.operators.awards import DEFAULT_AWARDS, AwardSpec

NEW_AWARD_COLUMNS = ("region", "achievement_id", "pax_id", "date_awarded", "period_kind", "period")


def attach_pax_id(earned: DataFrame, users: DataFrame) -> DataFrame:
    """Map each earned award's email to the home region's user id (inner join on region + email).

    Fans out if a region has several accounts with one email, like the source.
    Columns: achievement_id, period_kind, period, region, pax_id, date_awarded.
    """
    u = users.select("region", "email", F.col("user_id").alias("pax_id"))
    return earned.join(u, ["region", "email"]).select(
        "achievement_id", "period_kind", "period", "region", "pax_id", "date_awarded"
    )


def period_kind_of(achievement_id: Column, specs: Sequence[AwardSpec] = DEFAULT_AWARDS) -> Column:
    """Period kind of an award id as an expression (ids outside the specs count per year)."""
    expr = None
    for s in specs:
        if s.period_kind == "year":
            continue
        cond = achievement_id == F.lit(s.id)
        expr = F.when(cond, F.lit(s.period_kind)) if expr is None else expr.when(cond, F.lit(s.period_kind))
    return F.lit("year") if expr is None else expr.otherwise(F.lit("year"))


def award_history(awarded: DataFrame, award_list: DataFrame, as_of: _dt.date | str) -> DataFrame:
    """SRC5/J6: awards given in the calendar year of ``as_of`` whose id is still in the region's list, with ``code``."""
    lst = award_list.select("region", F.col("id").alias("achievement_id"), "code")
    cur = awarded.where(periods.in_year_of("date_awarded", as_of))
    return cur.join(lst, ["region", "achievement_id"])


def eligible_regions(
    region_config: DataFrame, award_list: DataFrame, exclude: Iterable[str] = EXCLUDED_REGIONS_AWARDS
) -> DataFrame:
    """regions signed up for awards: an award channel, an award list, not deny-listed.

    Columns: region, achievement_channel.
    """
    cfg = region_config.where(F.col("achievement_channel").isNotNull())
    exclude = list(exclude)
    if exclude:
        cfg = cfg.where(~F.col("region").isin(exclude))
    return cfg.join(award_list.select("region").distinct(), "region", "left_semi").select(
        "region", "achievement_channel"
    )


def unseen_awards(earned_pax: DataFrame, history: DataFrame, specs: Sequence[AwardSpec] = DEFAULT_AWARDS) -> DataFrame:
    """Earned awards not yet given to that person in that period (null-safe anti join).

    ``earned_pax`` comes from ``attach_pax_id``; ``history`` from ``award_history``.
    The history's period is recomputed from ``date_awarded`` with the award's
    period kind (ISO week for weekly awards, no year in month/week keys).
    """
    h = history.select(
        F.col("region").alias("h_region"),
        F.col("achievement_id").alias("h_award"),
        periods.period_of_kind(period_kind_of(F.col("achievement_id"), specs), "date_awarded").alias("h_period"),
        F.col("pax_id").alias("h_pax"),
    )
    cond = (
        (F.col("region") == F.col("h_region"))
        & (F.col("achievement_id") == F.col("h_award"))
        & F.col("period").eqNullSafe(F.col("h_period"))
        & F.col("pax_id").eqNullSafe(F.col("h_pax"))
    )
    return earned_pax.join(h, cond, "left_anti")


def new_awards(
    earned_pax: DataFrame,
    history: DataFrame,
    award_list: DataFrame,
    regions: DataFrame,
    specs: Sequence[AwardSpec] = DEFAULT_AWARDS,
) -> DataFrame:
    """U19 + J12/F19/F20/U24: unseen awards of eligible regions whose id is in the region's award list.

    ``regions`` comes from ``eligible_regions``. Columns: NEW_AWARD_COLUMNS.
    """
    fresh = unseen_awards(earned_pax.join(regions.select("region"), "region", "left_semi"), history, specs)
    listed = award_list.select("region", F.col("id").alias("achievement_id"))
    return fresh.join(listed, ["region", "achievement_id"], "left_semi").select(*NEW_AWARD_COLUMNS)


def recorded_awards(history: DataFrame, specs: Sequence[AwardSpec] = DEFAULT_AWARDS) -> DataFrame:
    """Recorded awards with the period recomputed from their date. Columns: NEW_AWARD_COLUMNS."""
    kind = period_kind_of(F.col("achievement_id"), specs)
    return history.withColumns({"period_kind": kind, "period": periods.period_of_kind(kind, "date_awarded")}).select(*NEW_AWARD_COLUMNS)


def award_counts(history: DataFrame) -> DataFrame:
    """Awards per (region, pax, award) already given this year (manual awards included).

    Columns: region, pax_id, achievement_id, n (bigint).
    """
    return history.groupBy("region", "pax_id", "achievement_id").agg(F.count("id").alias("n"))


#: Rows of one person are numbered in id order, then by date and period within one id: the source's processing order, made deterministic.
_PERSON = ("region", "pax_id")


def _numbered(rows: DataFrame) -> DataFrame:
    """``total_awards`` and ``nth_time`` of the rows with ``fresh`` = 1, counted on from those with 0; ``n`` is what a row counts for.

    Both running sums are per person, so the rows are clustered by person
    once. Their number is what one person holds and earns in a year.
    """
    per_award = Window.partitionBy(*_PERSON, "achievement_id").orderBy("fresh", "date_awarded", "period").rowsBetween(Window.unboundedPreceding, 0)
    # the number within the award breaks ties of the person's order, so identical rows
    # (several sites of one per-site award) pair their numbers consistently
    per_pax = Window.partitionBy(*_PERSON).orderBy("fresh", "achievement_id", "nth_time").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("nth_time", F.sum("n").over(per_award).cast("long")).withColumn("total_awards", F.sum("n").over(per_pax).cast("long"))
    return counted.where(F.col("fresh") == 1).select(*NEW_AWARD_COLUMNS, "total_awards", "nth_time")


def award_ordinals(new: DataFrame, counts: DataFrame) -> DataFrame:
    """Running "achievement #k" and "n-th time this year" for each new award.

    The prior counts and the new awards are one table, numbered by running
    sums over each person's rows; no count is joined.
    Columns: NEW_AWARD_COLUMNS + total_awards, nth_time.
    """
    prior = counts.select(*_PERSON, "achievement_id", "n", F.lit(0).alias("fresh"))
    fresh = new.select(*NEW_AWARD_COLUMNS, F.lit(1).cast("long").alias("n"), F.lit(1).alias("fresh"))
    return _numbered(fresh.unionByName(prior, allowMissingColumns=True).repartition(*_PERSON))


def new_award_ordinals(
    earned_pax: DataFrame,
    history: DataFrame,
    award_list: DataFrame,
    regions: DataFrame,
    specs: Sequence[AwardSpec] = DEFAULT_AWARDS,
) -> DataFrame:
    """U19 + U20 + U21 in one pass: ``award_ordinals(new_awards(...), award_counts(history))``.

    History and earned awards meet in one exchange by person. There an earned
    award is new if no history row has its award and period, and the rest is
    numbered on from the history: the history is read once, for both.
    """
    kind = period_kind_of(F.col("achievement_id"), specs)
    held = history.select(
        *_PERSON,
        "achievement_id",
        "date_awarded",
        periods.period_of_kind(kind, "date_awarded").cast("int").alias("period"),
        F.col("id").isNotNull().cast("long").alias("n"),
        F.lit(0).alias("fresh"),
    )
    listed = award_list.select("region", F.col("id").alias("achievement_id"))
    earned = earned_pax.join(regions.select("region"), "region", "left_semi").join(listed, ["region", "achievement_id"], "left_semi")
    fresh = earned.select(*NEW_AWARD_COLUMNS, F.lit(1).cast("long").alias("n"), F.lit(1).alias("fresh"))
    rows = fresh.unionByName(held, allowMissingColumns=True).repartition(*_PERSON)
    # a window counts NULL keys as equal, as the null-safe anti join does
    same = Window.partitionBy(*_PERSON, "achievement_id", "period")
    seen = rows.withColumn("known", F.min("fresh").over(same) == 0)
    return _numbered(seen.where((F.col("fresh") == 0) | ~F.col("known")).drop("known"))


def upload_rows(new: DataFrame) -> DataFrame:
    """U24/SNK1 payload: (region, achievement_id, pax_id, date_awarded)."""
    return new.select("region", "achievement_id", "pax_id", "date_awarded")
