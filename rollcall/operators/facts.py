"""The national post fact: users x attendance x events x sites, all regions in one plan.

Every join carries ``region`` in its key (the source ran one query per region
schema and concatenated them). Event joins take (region, site, date) as hash
keys; the "attendance's leader is the event's leader or co-leader" rule stays a
residual predicate of that equi-join, so Spark plans a hash / sort-merge join,
never a nested loop. Skewed (region, site, date) keys are split by AQE's
skew-join handling; the user and site dimensions are broadcast by Spark only
when their measured size is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.constants import EXCLUDED_REGIONS_FACT, NO_EMAIL, SYSTEM_USER_NAME
from rollcall.functions import classify, periods


def _events_join(
    users: DataFrame,
    attendance: DataFrame,
    beatdowns: DataFrame,
    aos: DataFrame,
    leader_rule: str,
    event_filter: Column | None,
    user_filter: Column | None,
    date_filter: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """``date_filter`` builds the date predicate for a date column; it is applied to the
    event date *and* to the attendance date (equal under the join), because Catalyst
    does not carry it across the join and the attendance scan is the largest one."""
    u = users.alias("u")
    a = attendance.alias("a")
    b = beatdowns.alias("b")
    if date_filter is not None:
        a = a.where(date_filter(F.col("date"))).alias("a")
        b = b.where(date_filter(F.col("bd_date"))).alias("b")
    if event_filter is not None:
        b = b.where(event_filter).alias("b")
    if user_filter is not None:
        u = u.where(user_filter).alias("u")
    site = aos.select("region", "channel_id", "ao").alias("ao")

    same_event = (
        (F.col("a.region") == F.col("b.region"))
        & (F.col("a.ao_id") == F.col("b.ao_id"))
        & (F.col("a.date") == F.col("b.bd_date"))
    )
    if leader_rule == "q":
        same_event = same_event & (F.col("a.q_user_id") == F.col("b.q_user_id"))
    elif leader_rule == "q_or_coq":
        same_event = same_event & (
            (F.col("a.q_user_id") == F.col("b.q_user_id")) | (F.col("a.q_user_id") == F.col("b.coq_user_id"))
        )
    else:
        raise ValueError(leader_rule)

    return (
        a.join(u, (F.col("a.region") == F.col("u.region")) & (F.col("a.user_id") == F.col("u.user_id")))
        .join(b, same_event)
        .join(site, (F.col("b.region") == F.col("ao.region")) & (F.col("b.ao_id") == F.col("ao.channel_id")))
    )


def _region_filter(df_region: Column, exclude: Iterable[str]) -> Column | None:
    exclude = list(exclude)
    return ~df_region.isin(exclude) if exclude else None


def classified_events(
    beatdowns: DataFrame,
    aos: DataFrame,
    qsource: Column | None = None,
    workout: Column | None = None,
) -> DataFrame:
    """One row per event and site row, with the class flags; the write-up stays behind.

    The write-up's half of the classifiers is evaluated on the events and the
    site name's half on the sites, each once per row of its own table; only
    flags meet in the join. Injected predicates read both columns at once, so with
    them the write-up goes into this join of events and sites, no further.
    Columns: region, ao_id, bd_date, q_user_id, coq_user_id, ao, is_qs, is_w.
    """
    text = [F.col("backblast")] if qsource is not None or workout is not None else []
    b = beatdowns.select("region", "ao_id", "bd_date", "q_user_id", "coq_user_id", classify.backblast_is_qsource("backblast").alias("bb_qs"), *text)
    site = aos.select(
        "region",
        F.col("channel_id").alias("ao_id"),
        "ao",
        classify.ao_is_qsource("ao").alias("ao_qs"),
        classify.ao_is_not_workout("ao").alias("ao_nw"),
    )
    bb, no = F.col("bb_qs"), F.lit(False)
    is_qs = F.coalesce(bb | F.col("ao_qs") if qsource is None else qsource, no)
    is_w = F.coalesce(~bb & ~F.col("ao_nw") if workout is None else workout, no)
    return b.join(site, ["region", "ao_id"]).select("region", "ao_id", "bd_date", "q_user_id", "coq_user_id", "ao", is_qs.alias("is_qs"), is_w.alias("is_w"))


def event_posts(
    users: DataFrame,
    attendance: DataFrame,
    beatdowns: DataFrame,
    aos: DataFrame,
    since: _dt.date | None = None,
    exclude: Iterable[str] = EXCLUDED_REGIONS_FACT,
    qsource: Column | None = None,
    workout: Column | None = None,
) -> DataFrame:
    """All J2 pairs (leader is the event's Q or co-Q) of dated events, with the J1 rule as a flag.

    One join serves both national facts: ``q_match`` (the attendance's leader is
    the event's Q) selects the J1 rows, ``valid_posts`` applies the J2 filters.
    ``since`` bounds event dates from below (pushed into the event scan). The events
    are classified before the join (``classified_events``), so no write-up meets the
    attendance, and the attendance meets the events first: tables stored
    by (region, site, date) join without an exchange.
    Columns: site_region, email, user_name, user_id, ao_id, ao, date, q_flag,
    q_match, has_q, is_qs, is_w.
    """
    def dates(c: Column) -> Column:
        return c.isNotNull() if since is None else c >= F.lit(since)

    b = beatdowns.where(dates(F.col("bd_date")))
    ev = _region_filter(F.col("region"), exclude)
    if ev is not None:
        b = b.where(ev)
    events = classified_events(b, aos, qsource, workout).alias("b")
    a = attendance.where(dates(F.col("date"))).alias("a")
    u = users.alias("u")
    leads = (F.col("a.q_user_id") == F.col("b.q_user_id")) | (F.col("a.q_user_id") == F.col("b.coq_user_id"))
    same_event = (F.col("a.region") == F.col("b.region")) & (F.col("a.ao_id") == F.col("b.ao_id")) & (F.col("a.date") == F.col("b.bd_date"))
    j = a.join(events, same_event & leads).join(u, (F.col("a.region") == F.col("u.region")) & (F.col("a.user_id") == F.col("u.user_id")))
    q_flag = F.when(
        (F.col("a.user_id") == F.col("b.q_user_id")) | (F.col("a.user_id") == F.col("b.coq_user_id")), F.lit(1)
    ).otherwise(F.lit(0))
    return j.select(
        F.col("a.region").alias("site_region"),
        F.col("u.email").alias("email"),
        F.col("u.user_name").alias("user_name"),
        F.col("a.user_id").alias("user_id"),
        F.col("a.ao_id").alias("ao_id"),
        F.col("b.ao").alias("ao"),
        F.col("b.bd_date").alias("date"),
        q_flag.alias("q_flag"),
        F.coalesce(F.col("a.q_user_id") == F.col("b.q_user_id"), F.lit(False)).alias("q_match"),
        F.col("b.q_user_id").isNotNull().alias("has_q"),
        F.col("b.is_qs").alias("is_qs"),
        F.col("b.is_w").alias("is_w"),
    )


def q_attendance(events: DataFrame) -> DataFrame:
    """J1 rows of ``event_posts``: (region, email, user_id, bd_date)."""
    return events.where(F.col("q_match")).select(
        F.col("site_region").alias("region"), "email", "user_id", F.col("date").alias("bd_date")
    )


def valid_posts(events: DataFrame, as_of: _dt.date | str, current_year: bool = True) -> DataFrame:
    """J2 filters on ``event_posts``: event has a Q, not after ``as_of`` (and in its year), valid user.

    Columns: email, user_name, ao_id, ao, date, q_flag, is_qs, is_w, site_region, user_id.
    """
    cond = F.col("has_q") & periods.not_after("date", as_of)
    if current_year:
        cond = cond & periods.in_year_of("date", as_of)
    cond = cond & (F.col("email") != NO_EMAIL) & (F.col("user_name") != SYSTEM_USER_NAME)
    return events.where(cond).select(
        "email", "user_name", "ao_id", "ao", "date", "q_flag", "is_qs", "is_w", "site_region", "user_id"
    )


def attendance_fact(
    users: DataFrame,
    attendance: DataFrame,
    beatdowns: DataFrame,
    aos: DataFrame,
    exclude: Iterable[str] = EXCLUDED_REGIONS_FACT,
    since: _dt.date | None = None,
) -> DataFrame:
    """J1 (leader must be the event's Q): (region, email, user_id, bd_date) per attendance row.

    Base of the home-region counts. ``since`` optionally bounds dates from below
    (a range predicate pushed into the event scan).
    """
    ev = _region_filter(F.col("region"), exclude)
    dates = None if since is None else (lambda c: c >= F.lit(since))
    j = _events_join(users, attendance, beatdowns, aos, "q", ev, None, dates)
    return j.select(
        F.col("a.region").alias("region"),
        F.col("u.email").alias("email"),
        F.col("a.user_id").alias("user_id"),
        F.col("b.bd_date").alias("bd_date"),
    )


def post_fact(
    users: DataFrame,
    attendance: DataFrame,
    beatdowns: DataFrame,
    aos: DataFrame,
    as_of: _dt.date | str,
    current_year: bool = True,
    exclude: Iterable[str] = EXCLUDED_REGIONS_FACT,
    since: _dt.date | None = None,
) -> DataFrame:
    """J2 national post fact (leader is the event's Q or co-Q) with the validity filters.

    ``current_year=True`` is the award variant (calendar year of ``as_of``, up to
    ``as_of``); ``False`` is the report variant (all dated events up to ``as_of``,
    or from ``since`` on).
    Columns: email, user_name, ao_id, ao, date, q_flag, backblast, site_region, user_id.
    ``site_region`` is where the post happened; the home region is attached later.
    """
    ev = F.col("q_user_id").isNotNull()
    rf = _region_filter(F.col("region"), exclude)
    if rf is not None:
        ev = ev & rf

    def dates(c: Column) -> Column:
        cond = periods.not_after(c, as_of)
        cond = cond & periods.in_year_of(c, as_of) if current_year else cond & c.isNotNull()
        return cond if since is None else cond & (c >= F.lit(since))

    valid_user = (F.col("email") != NO_EMAIL) & (F.col("user_name") != SYSTEM_USER_NAME)
    j = _events_join(users, attendance, beatdowns, aos, "q_or_coq", ev, valid_user, dates)
    q_flag = F.when(
        (F.col("a.user_id") == F.col("b.q_user_id")) | (F.col("a.user_id") == F.col("b.coq_user_id")), F.lit(1)
    ).otherwise(F.lit(0))
    return j.select(
        F.col("u.email").alias("email"),
        F.col("u.user_name").alias("user_name"),
        F.col("a.ao_id").alias("ao_id"),
        F.col("ao.ao").alias("ao"),
        F.col("b.bd_date").alias("date"),
        q_flag.alias("q_flag"),
        F.col("b.backblast").alias("backblast"),
        F.col("a.region").alias("site_region"),
        F.col("a.user_id").alias("user_id"),
    )


def attach_home_region(fact: DataFrame, home: DataFrame, with_user: bool = False) -> DataFrame:
    """Every post of a person is credited to the person's home region (inner join on email).

    ``home`` has one row per email (``pick_home_region``); people without a home
    region (no post this year) are dropped. With ``with_user`` the home region's
    user id replaces the attendance user id.
    """
    cols = ["email", "region"] + (["user_id"] if with_user else [])
    h = home.select(*cols)
    f = fact.drop("site_region")
    if with_user:
        f = f.drop("user_id")
    return f.join(h, "email")


def led_posts(
    attendance: DataFrame, beatdowns: DataFrame, aos: DataFrame, exclude: Iterable[str] = EXCLUDED_REGIONS_FACT
) -> DataFrame:
    """J2 posts of the events' own leaders (``q_flag = 1``), accounts not yet named: (region, user_id, date).

    A leaders-only join: every event is exploded to its (at most two) leaders
    and joined with the attendance on (region, site, date, attendee = leader),
    the J2 leader rule kept as the residual. Its output is one row per led
    post instead of the whole national fact.
    """
    ev = F.col("q_user_id").isNotNull() & F.col("bd_date").isNotNull()
    rf = _region_filter(F.col("region"), exclude)
    if rf is not None:
        ev = ev & rf
    leaders = beatdowns.where(ev).select(
        "region",
        "ao_id",
        "bd_date",
        "q_user_id",
        "coq_user_id",
        F.explode(F.array_distinct(F.array_compact(F.array("q_user_id", "coq_user_id")))).alias("leader"),
    ).alias("b")
    a = attendance.where(F.col("date").isNotNull()).alias("a")
    site = aos.select("region", "channel_id").alias("ao")
    led = a.join(
        leaders,
        (F.col("a.region") == F.col("b.region"))
        & (F.col("a.ao_id") == F.col("b.ao_id"))
        & (F.col("a.date") == F.col("b.bd_date"))
        & (F.col("a.user_id") == F.col("b.leader"))
        & ((F.col("a.q_user_id") == F.col("b.q_user_id")) | (F.col("a.q_user_id") == F.col("b.coq_user_id"))),
    ).join(site, (F.col("b.region") == F.col("ao.region")) & (F.col("b.ao_id") == F.col("ao.channel_id")), "left_semi")
    return led.select(F.col("a.region").alias("region"), F.col("a.user_id").alias("user_id"), F.col("a.date").alias("date"))


def ever_led(
    users: DataFrame,
    attendance: DataFrame,
    beatdowns: DataFrame,
    aos: DataFrame,
    as_of: _dt.date | str,
    exclude: Iterable[str] = EXCLUDED_REGIONS_FACT,
) -> DataFrame:
    """Emails with at least one J2 post as the event's Q or co-Q (``q_flag = 1``) up to ``as_of``.

    From ``led_posts`` over all history; ``led_state`` keeps the same by month
    for the weekly run. Columns: email.
    """
    upto = attendance.where(periods.not_after("date", as_of))
    led = led_posts(upto, beatdowns.where(periods.not_after("bd_date", as_of)), aos, exclude)
    u = users.where((F.col("email") != NO_EMAIL) & (F.col("user_name") != SYSTEM_USER_NAME))
    return led.join(u.select("region", "user_id", "email"), ["region", "user_id"]).select("email").distinct()
